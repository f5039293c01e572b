"""Statistics of one whole text, used by the quality rules and the quality classifier."""

from __future__ import annotations

import numpy as np

from omiclake.llm.common import mixed, prefix_hash, window_hash

#: ASCII white space: space, and tab to carriage return.
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
#: The symbols that the rules count.
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True


def words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs that aren't white space."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~SPACE[data]
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def repeated(hashes: np.ndarray) -> tuple[np.ndarray, int]:
    """Which hashes occur twice or more, and how many distinct ones there are."""
    found, inverse, count = np.unique(hashes, return_inverse=True, return_counts=True)
    return count[inverse] > 1, len(found)


class Text:
    """A text's bytes, word places and 64-bit word hashes."""

    def __init__(self, text: bytes) -> None:
        self.text = text
        self.data = np.frombuffer(text, np.uint8)
        self.start, self.end = words(self.data)
        self.hash = window_hash(prefix_hash(self.data), self.start, self.end)
        self.n_words = len(self.start)

    def word_chars(self) -> int:
        d = self.data
        return int((~SPACE[d] & ((d & 0xC0) != 0x80)).sum())

    def n_symbols(self) -> int:
        return int(SYMBOLS[self.data].sum())

    def n_dup_lines(self) -> int:
        lines = [x for x in self.text.split(b"\n") if x.strip()]
        return len(lines) - len(set(lines))

    def n_repeat_words(self) -> int:
        """Words within 3-word windows that occur twice or more."""
        h = self.hash
        if len(h) < 4:
            return 0
        again, _ = repeated(mixed(h[:-2]) + mixed(h[1:-1] * np.uint64(3)) * np.uint64(5) + mixed(h[2:] * np.uint64(7)) * np.uint64(11))
        near = np.zeros(len(h), bool)
        for k in range(3):
            near[k : k + len(again)] |= again
        return int(near.sum())


#: What features() returns, in order.
FEATURES = (
    "log_chars", "log_words", "mean_word", "sd_word", "long_words", "short_words", "upper", "digits", "punctuation", "symbols",
    "bars", "bangs", "spaces", "newlines", "non_ascii", "controls", "distinct_words", "top_word", "repeat_words", "repeat_pairs",
    "same_as_last", "dup_lines", "mean_line", "entropy", "distinct_bytes", "upper_words", "marked_words", "end_marks", "at_signs", "slashes",
)


def features(text: bytes) -> np.ndarray:
    """One double for each of FEATURES; an empty text gives zeros."""
    t = Text(text)
    d, n, w = t.data, len(t.data), t.n_words
    out = np.zeros(len(FEATURES))
    if not n:
        return out
    count = np.bincount(d, minlength=256)
    share = lambda chars: count[list(chars)].sum() / n
    upper, digits = share(range(65, 91)), share(range(48, 58))
    non_ascii, controls = count[128:].sum() / n, share([*range(9), *range(14, 32), 127])
    p = count[count > 0] / n
    lines = text.split(b"\n")
    out[:2] = np.log1p(n), np.log1p(w)
    out[6:17] = (
        upper, digits, share([*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]), share(b"#*$%&|<>"), share(b"|"), share(b"!"),
        share(b" "), share(b"\n"), non_ascii, controls, 0,
    )
    out[21:25] = t.n_dup_lines() / len(lines), np.log1p(n / len(lines)), -(p * np.log2(p)).sum(), len(p) / 256
    out[28:30] = share(b"@"), share(b"/")
    if w:
        size = t.end - t.start
        first, last = d[t.start], d[t.end - 1]
        _, inverse, times = np.unique(t.hash, return_inverse=True, return_counts=True)
        out[2:6] = size.mean(), size.std(), (size > 20).mean(), (size <= 3).mean()
        out[16:19] = len(times) / w, times.max() / w, t.n_repeat_words() / w
        if w > 1:
            out[19] = repeated(mixed(t.hash[:-1]) + t.hash[1:])[0].mean()
            out[20] = (t.hash[1:] == t.hash[:-1]).mean()
        out[25] = ((first >= 65) & (first <= 90)).mean()
        marks = SYMBOLS | np.isin(np.arange(256), list(b"!?=~^_"))
        out[26], out[27] = marks[last].mean(), np.isin(last, list(b".!?")).mean()
    return out
