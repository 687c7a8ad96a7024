"""Guessing the encoding of bytes that no mark and no valid UTF-8 names.

Every multi-byte encoding is a small machine of coding states. A piece of bytes is summed up as what the
machine does from each state it may be in before: the state after, errors, characters and common
characters. Such sums of neighbours join to that of both, in whole numbers, so a file may be cut anywhere
and pieces may be read in any order. Single-byte encodings are scored by pairs of neighbouring
bytes: by whether their characters stand beside each other in text. UTF-16 without a mark shows by zero
bytes at even or odd places.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable
from functools import lru_cache

import numpy as np

# --- fixed values: encodings, their coding ranges, and letters that are frequent in text ---
SINGLE_BYTE = ["cp1252", "cp850", "mac_roman", "cp1251", "koi8_r", "cp1253"]
# Per encoding: lead bytes, trail bytes, lead bytes of common characters, bytes that stand alone.
DOUBLE_BYTE = {
    "gb18030": ([(0x81, 0xFE)], [(0x40, 0x7E), (0x80, 0xFE)], [(0xA1, 0xA3), (0xB0, 0xD7)], []),
    "big5": ([(0x81, 0xFE)], [(0x40, 0x7E), (0xA1, 0xFE)], [(0xA1, 0xC6)], []),
    "shift_jis": ([(0x81, 0x9F), (0xE0, 0xFC)], [(0x40, 0x7E), (0x80, 0xFC)], [(0x81, 0x83), (0x88, 0x97)], [(0xA1, 0xDF)]),
    "euc_jp": ([(0x8E, 0x8E), (0xA1, 0xFE)], [(0xA1, 0xFE)], [(0xA1, 0xA5), (0xB0, 0xCF)], []),
    "euc_kr": ([(0xA1, 0xFE)], [(0xA1, 0xFE)], [(0xA1, 0xA3), (0xB0, 0xC8)], []),
}
# Rows that only text of that encoding uses much: kana and Hangul.
OWN_ROWS = {"shift_jis": [(0x82, 0x83)], "euc_jp": [(0xA4, 0xA5)], "euc_kr": [(0xB0, 0xC8)]}
FREQUENT = "éèàçùâêîôûäöüßñáíóúãõåæøœ¿¡«»оеаинтсрвлкмдпуяыьгзбчйхαετοινσρκπμλάέήίόύώ"
# -----------------------------------------------------------------------------------------

UTF8 = "utf-8"
MACHINES = [UTF8, *DOUBLE_BYTE]
STATES = 8
# A summary: these counts, a score for each single-byte encoding, then for every machine and state before
# it the state after, errors, characters, common characters, and those of its own rows.
HEAD = ["n_bytes", "n_high", "zeros_even", "zeros_odd", "first", "last"]
_SCORES = len(HEAD)
_TABLES = _SCORES + len(SINGLE_BYTE)
LENGTH = _TABLES + len(MACHINES) * STATES * 5
# Bytes whose steps are joined at once; counts of so many fit the packed fields.
_BLOCK = 1 << 16
_FIELD = 21


def _within(ranges: Iterable[tuple[int, int]]) -> np.ndarray:
    out = np.zeros(256, bool)
    for a, b in ranges:
        out[a : b + 1] = True
    return out


def _packed(errors, chars, common, own):
    # Four counts in two numbers: errors and characters, common and own.
    return errors + (chars << _FIELD), common + (own << _FIELD)


@lru_cache(maxsize=1)
def _machines() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every machine, byte and state: the next state, and packed counts of that step."""
    step = np.zeros((len(MACHINES), 256, STATES), np.uint8)
    counts = np.zeros((len(MACHINES), 256, STATES, 4), np.int64)
    # UTF-8: 0 between characters, 1 to 3 with that many bytes to come, 4 to 7 where the first of them is bounded.
    first = {b: 0 for b in range(0x80)} | {b: 1 for b in range(0xC2, 0xE0)} | {b: 2 for b in range(0xE1, 0xF0)} | {b: 3 for b in range(0xF1, 0xF4)}
    first |= {0xE0: 4, 0xED: 5, 0xF0: 6, 0xF4: 7}
    follow = {1: (0x80, 0xBF, 0), 2: (0x80, 0xBF, 1), 3: (0x80, 0xBF, 2), 4: (0xA0, 0xBF, 1), 5: (0x80, 0x9F, 1), 6: (0x90, 0xBF, 2), 7: (0x80, 0x8F, 2)}
    for b in range(256):
        for s in range(STATES):
            if s and follow[s][0] <= b <= follow[s][1]:
                step[0, b, s] = follow[s][2]
                counts[0, b, s, 1] = follow[s][2] == 0
            else:
                step[0, b, s] = first.get(b, 0)
                counts[0, b, s, 0] = (s != 0) + (b not in first)
    # Two bytes: 0 between characters, 1 behind a lead, 2 behind a common one, 3 behind one of the own rows.
    for m, name in enumerate(MACHINES):
        if name == UTF8:
            continue
        leads, trails, common, alone = map(_within, DOUBLE_BYTE[name])
        own = _within(OWN_ROWS.get(name, []))
        for b in range(256):
            fresh = 0 if b < 0x80 or alone[b] or not leads[b] else 3 if own[b] else 2 if common[b] else 1
            for s in range(STATES):
                if s and trails[b]:
                    counts[m, b, s] = (0, 1, s >= 2, s == 3)
                else:
                    step[m, b, s] = fresh
                    counts[m, b, s, 0] = (s != 0) + (b >= 0x80 and fresh == 0 and not alone[b])
    low, high = _packed(counts[..., 0], counts[..., 1], counts[..., 2], counts[..., 3])
    return step, low, high


def _kind(ch: str | None) -> tuple[str, str]:
    """Undefined, control, space, digit, lower, upper, punctuation or other; and a letter's script."""
    if ch is None:
        return "undefined", ""
    if ch in "\t\n\r ":
        return "space", ""
    category = unicodedata.category(ch)
    if category == "Cc":
        return "control", ""
    if category[0] == "L":
        script = unicodedata.name(ch, "").split(" ")[0]
        return ("upper" if category == "Lu" else "lower"), script if script in ("CYRILLIC", "GREEK") else "LATIN"
    return ("digit" if category == "Nd" else "mark" if category[0] == "P" else "space" if category == "Zs" else "other"), ""


def _pair_score(a: str | None, b: str | None) -> int:
    (x, script_x), (y, script_y) = _kind(a), _kind(b)
    kinds = {x, y}
    if "undefined" in kinds:
        return -100
    if "control" in kinds:
        return -40
    bonus = sum(2 for ch in (a, b) if ch.lower() in FREQUENT)
    if script_x and script_y:
        if script_x != script_y:
            return -12
        return bonus + {"lowerlower": 4, "upperlower": 3, "lowerupper": -8, "upperupper": 1}[x + y]
    if "other" in kinds:
        return -6 if script_x or script_y else -3
    if script_x or script_y:
        return bonus + (1 if "space" in kinds else -1 if "mark" in kinds else -3)
    return 0


@lru_cache(maxsize=1)
def _pair_scores() -> np.ndarray:
    out = np.zeros((len(SINGLE_BYTE), 256, 256), np.int64)
    for c, name in enumerate(SINGLE_BYTE):
        chars = []
        for b in range(256):
            try:
                chars.append(bytes([b]).decode(name))
            except UnicodeDecodeError:
                chars.append(None)
        for a in range(256):
            for b in range(0 if a >= 0x80 else 0x80, 256):
                out[c, a, b] = _pair_score(chars[a], chars[b])
    return out.reshape(len(SINGLE_BYTE), -1)


def _steps(data: np.ndarray, machine: int) -> tuple[np.ndarray, np.ndarray]:
    """What a machine does with bytes, from every state: the state after, and counts (state, 4)."""
    step, low, high = (t[machine] for t in _machines())
    state, total = np.arange(STATES), np.zeros((STATES, 4), np.int64)
    for at in range(0, len(data), _BLOCK):
        block = data[at : at + _BLOCK]
        nxt, one, two = step[block].astype(np.int64), low[block], high[block]
        while len(nxt) > 1:
            if len(nxt) % 2:
                nxt, one, two = (np.concatenate([t, e]) for t, e in ((nxt, np.arange(STATES)[None]), (one, np.zeros((1, STATES), np.int64)), (two, np.zeros((1, STATES), np.int64))))
            then = np.arange(len(nxt) // 2)[:, None] * STATES + nxt[::2]
            one = one[::2] + one[1::2].reshape(-1)[then]
            two = two[::2] + two[1::2].reshape(-1)[then]
            nxt = nxt[1::2].reshape(-1)[then]
        one, two, mask = one[0][state], two[0][state], (1 << _FIELD) - 1
        total += np.stack([one & mask, one >> _FIELD, two & mask, two >> _FIELD], axis=1)
        state = nxt[0][state]
    return state, total


def summarize(content: bytes, start: int = 0) -> np.ndarray:
    """The summary of the bytes of a file from place ``start`` on."""
    out = np.zeros(LENGTH, np.int64)
    data = np.frombuffer(content, np.uint8)
    tables = out[_TABLES:].reshape(len(MACHINES), STATES, 5)
    tables[:, :, 0] = np.arange(STATES)
    out[4:6] = -1
    if not len(data):
        return out
    high = data >= 0x80
    zeros = np.flatnonzero(data == 0) + start
    out[:_SCORES] = len(data), high.sum(), (zeros % 2 == 0).sum(), (zeros % 2).sum(), data[0], data[-1]
    near = high.copy()
    near[1:] |= high[:-1]
    pairs = data[:-1].astype(np.int64)[near[1:]] * 256 + data[1:][near[1:]]
    if len(pairs):
        out[_SCORES:_TABLES] = _pair_scores()[:, pairs].sum(axis=1)
    # Between characters after any ASCII byte, machines stay there until the next byte above.
    near[0] = True
    told = data[near]
    for m in range(len(MACHINES)):
        tables[m, :, 0], tables[m, :, 1:] = _steps(told, m)
    return out


def join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The summary of two neighbours' bytes."""
    if not a[0] or not b[0]:
        return a if a[0] else b
    out = a + b
    out[4], out[5] = a[4], b[5]
    if a[5] >= 0x80 or b[4] >= 0x80:
        out[_SCORES:_TABLES] += _pair_scores()[:, a[5] * 256 + b[4]]
    first, then, both = (t[_TABLES:].reshape(len(MACHINES), STATES, 5) for t in (a, b, out))
    for m in range(len(MACHINES)):
        after = first[m, :, 0]
        both[m] = then[m][after]
        both[m, :, 1:] += first[m, :, 1:]
    return out


def decide(summary: np.ndarray) -> str:
    """The likeliest encoding; bytes below 128 alone are UTF-8."""
    n, n_high, even, odd = (int(x) for x in summary[:4])
    if odd and odd * 10 >= n * 2 and odd >= 10 * even:
        return "utf-16-le"
    if even and even * 10 >= n * 2 and even >= 10 * odd:
        return "utf-16-be"
    if not n_high:
        return UTF8
    from_start = summary[_TABLES:].reshape(len(MACHINES), STATES, 5)[:, 0]
    best, best_share = None, 0
    for name, (after, errors, chars, common, own) in zip(MACHINES, from_start.tolist(), strict=True):
        # A character that the end cuts off is no error.
        if name == UTF8:
            if errors * 20 <= chars:
                return UTF8
        # Letters with accents among ASCII ones look like leads, but hardly any trail is above 127 then.
        elif chars and errors * 50 <= chars and common * 100 >= chars * 70 and n_high * 10 >= chars * 12:
            share = (common + (2 * own if own * 100 >= chars * 20 else 0)) * 1000 // chars
            if share > best_share:
                best, best_share = name, share
    if best:
        return best
    scores = summary[_SCORES:_TABLES].tolist()
    return SINGLE_BYTE[scores.index(max(scores))]


def guess(content: bytes) -> str:
    return decide(summarize(content))
