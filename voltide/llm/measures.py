"""Measurements of a text that rules and classifiers read; each is taken once, over the whole text."""

from __future__ import annotations

import numpy as np

from voltide.llm.arrays import SPACE, Texts, chained, mixed

SYMBOL = np.zeros(256, bool)
SYMBOL[np.frombuffer(b"#*$%&|<>", np.uint8)] = True
UPPER, LOWER, DIGIT, MARK = np.zeros((4, 256), bool)
UPPER[65:91] = LOWER[97:123] = DIGIT[48:58] = True
MARK[np.frombuffer(b"!?;:()[]{}\"'=/\\_@^~`+", np.uint8)] = True

NAMES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_lower", "n_digits", "n_marks", "n_bytes",
    "n_distinct_words", "n_twin_words", "longest_word",
)


def repeated(keys: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sort order of ``keys`` by owner and key, and which of the sorted keys equal the one before."""
    own = mixed(keys ^ mixed(owners.astype(np.uint64) + np.uint64(77)))
    order = np.argsort(own, kind="stable")
    ranked = own[order]
    return order, np.concatenate([[False], ranked[1:] == ranked[:-1]]) if len(ranked) else np.empty(0, bool)


def measured(texts: Texts) -> dict[str, np.ndarray]:
    """One array per name of ``NAMES``, one entry per text."""
    data, n = texts.data, texts.n
    starts, ends, owners = texts.words()
    hashes = texts.hashes(starts, ends)
    inner = ~SPACE[data]
    out = {"n_words": np.bincount(owners, minlength=n), "word_chars": texts.sums(inner & ((data & 0xC0) != 0x80)), "n_symbols": texts.sums(SYMBOL[data])}

    total = np.concatenate([[0], np.cumsum(inner, dtype=np.int64)])
    line_starts, line_ends = texts.lines()
    full = total[line_ends] > total[line_starts]
    line_starts, line_ends = line_starts[full], line_ends[full]
    of = texts.owner(line_starts)
    order, again = repeated(texts.hashes(line_starts, line_ends), of)
    out |= {"n_dup_lines": np.bincount(of[order][again], minlength=n), "n_lines": np.bincount(of, minlength=n)}

    windows, at = chained(hashes, owners, 3)
    order, again = repeated(windows, owners[at])
    twice = again.copy()
    twice[:-1] |= again[1:]
    hit = np.zeros(len(owners), bool)
    for k in range(3):
        hit[at[order][twice] + k] = True
    out["n_repeat_words"] = np.bincount(owners[hit], minlength=n)

    order, again = repeated(hashes, owners)
    out["n_distinct_words"] = np.bincount(owners[order][~again], minlength=n)
    twin = (hashes[1:] == hashes[:-1]) & (owners[1:] == owners[:-1])
    out["n_twin_words"] = np.bincount(owners[1:][twin], minlength=n)
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, owners, ends - starts)
    out["longest_word"] = longest
    out |= {name: texts.sums(table[data]) for name, table in (("n_upper", UPPER), ("n_lower", LOWER), ("n_digits", DIGIT), ("n_marks", MARK))}
    out["n_bytes"] = np.diff(texts.offsets)
    return {name: out[name].astype(np.int64) for name in NAMES}
