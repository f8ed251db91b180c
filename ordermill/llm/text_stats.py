"""Rule statistics of whole texts, used by the quality rules and the quality classifier."""

from __future__ import annotations

import numpy as np

SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))
LETTERS = UPPER + bytes(range(97, 123))
DIGITS = b"0123456789"

#: What ``stats_of`` returns for each text, in this order.
NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_chars", "n_lines", "n_upper",
         "n_letters", "n_digits", "n_exclaims", "n_bars", "n_distinct", "n_same_next", "n_stops", "longest_word")


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of three words which the text has twice or more."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    seen: dict[tuple, int] = {}
    again = set()
    for w in windows:
        if w in seen:
            again.add(w)
        seen[w] = 1
    covered, upto = 0, 0
    for at, w in enumerate(windows):
        if w in again:
            covered += at + 3 - max(at, upto)
            upto = at + 3
    return covered


def stats_of(text: str) -> tuple[int, ...]:
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # exactly the bytes 9 to 13 and 32 separate
    lines = [line for line in raw.split(b"\n") if line.strip()]
    without = lambda drop: len(raw) - len(raw.translate(None, drop))
    sizes = list(map(len, words))
    return (len(words), len(text) - (len(raw) - sum(sizes)), without(SYMBOLS), len(lines) - len(set(lines)),
            repeated_words(words), len(text), len(lines), without(UPPER), without(LETTERS), without(DIGITS),
            raw.count(b"!"), raw.count(b"|"), len(set(words)), sum(map(bytes.__eq__, words, words[1:])),
            raw.count(b"."), max(sizes, default=0))


def matrix(texts: list[str]) -> np.ndarray:
    return np.array([stats_of(t) for t in texts], np.int64).reshape(len(texts), len(NAMES))


#: The shares below, in this order.
SHARES = ("mean_word", "symbols", "dup_lines", "repeats", "upper", "exclaims", "bars", "same_next", "distinct", "digits",
          "words_per_line", "stops", "letters", "longest", "log_words")


def shares(stats: np.ndarray) -> np.ndarray:
    """Comparable figures of texts of any length; texts without words have zeros."""
    c = {n: stats[:, i].astype(np.float64) for i, n in enumerate(NAMES)}
    words, chars = np.maximum(c["n_words"], 1), np.maximum(c["n_chars"], 1)
    return np.stack([
        c["word_chars"] / words, c["n_symbols"] / words, c["n_dup_lines"] / np.maximum(c["n_lines"], 1),
        c["n_repeat_words"] / words, c["n_upper"] / np.maximum(c["n_letters"], 1), c["n_exclaims"] / words,
        c["n_bars"] / words, c["n_same_next"] / words, c["n_distinct"] / words, c["n_digits"] / chars,
        c["n_words"] / np.maximum(c["n_lines"], 1), c["n_stops"] / words, c["n_letters"] / chars, c["longest_word"],
        np.log1p(c["n_words"])], axis=1)
