"""Personal data: a linear-chain conditional random field over word shapes beside four fixed patterns.

The patterns find e-mail addresses, IPv4 addresses, card numbers and international phone numbers and always stay. The
field adds what has no fixed form: names, local phone numbers, national numbers, postal addresses, birth dates and
e-mail addresses spelled out. Tokens are runs of letters and digits; a token's features are its own shape and
those of its neighbours (and pairs of them with what stands between), and the words around it as far as the labelled
table has them more than twice. It is trained in numpy on a small labelled table and decoded by Viterbi over batches
of documents. Tagged spans that touch no pattern's span are added under ``crf_`` and their kind.

Training takes at most ``rows`` labelled rows, by hash; scanning covers whole texts in time proportional to their
length. Corner cases: null and empty texts have no spans; an empty labelled table gives a field that adds nothing, and
rows with contradicting labels count each for itself; repeated rows are scanned each for itself, a null doc_id like any
other; other columns pass through, but a column named spans is replaced; an empty table gives an empty table.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import crf, pii_examples
from plumbline.llm import textbytes as tb
from plumbline.llm.secrets import SPANS, _SPANS_ARROW, code_points

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, *(f"crf_{k}" for k in pii_examples.KINDS))

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def _luhn(digits: str) -> bool:
    twice = [int(d) * 2 for d in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(d - 9 if d > 9 else d for d in twice)) % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches: the run of address characters before an @, as far as the last match ended, and a domain behind."""
    out, at, free = [], text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            free = m.end()
        else:
            free = max(free, at + 1)
        at = text.find("@", max(at + 1, free))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the patterns, in code points, sorted. A failing match is dropped and not tried again shorter."""
    found = [(s, 0, e) for s, e in _emails(text)]
    found += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and _luhn(digits):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        found += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(found)


_TOKEN = np.zeros(256, bool)
_TOKEN[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_TOKEN[128:] = True
_GAP = np.zeros(256, np.int16)  # what may stand between tokens, a bit each; a plain space is none
for _bit, _signs in enumerate((b"@", b".", b"-", b"(", b")[]", b"/\\", b":=", b"\n\r", b"+", b",;", b"'\"`", b"#$|<>{}*_")):
    _GAP[list(_signs)] = 1 << _bit
_SHAPES = 64
_CODES = 2 + (1 << 12)  # row border or nothing between, and what the bits say


def _word_keys(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit keys of tokens from their length, first sixteen and last eight bytes in lower case."""
    low = np.concatenate([tb.LOWER[buf], np.zeros(16, np.uint8)])
    eight = np.ndarray((len(low) - 7,), "<u8", low, 0, (1,))
    size = ends - starts

    def cut(at, length):
        return eight[at] & np.where(length >= 8, np.uint64(0xFFFFFFFFFFFFFFFF), (np.uint64(1) << (np.clip(length, 0, 7) * 8).astype(np.uint64)) - np.uint64(1))

    first = cut(starts, size)
    long = np.flatnonzero(size > 8)
    key = first + size.astype(np.uint64)
    key[long] = tb.mix(tb.mix(first[long]) + eight[ends[long] - 8] * np.uint64(3) + cut(starts[long] + 8, size[long] - 8) * np.uint64(5)) + size[long].astype(np.uint64)
    return key


def _shapes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for a token's shape: digits by their count, letters by case, mixtures by what they begin and end with."""

    def count(mask):
        total = np.zeros(len(buf) + 1, np.int32)
        np.cumsum(mask, out=total[1:])
        return total[ends] - total[starts]

    upper, digit = (buf >= 65) & (buf <= 90), (buf >= 48) & (buf <= 57)
    size, ups, digits = ends - starts, count(upper), count(digit)
    first, last = upper[starts], digit[ends - 1]
    letters = np.where(ups == 0, np.where(size == 1, 21, 22), np.where(first & (ups == 1), np.where(size == 1, 23, 24), np.where(ups == size, 24 + np.minimum(size, 6), 31)))
    mixed = 32 + 1 * digit[starts] + 2 * last + 4 * (ups > 0) + 8 * np.digitize(size, (6, 12, 20))
    return np.where(digits == size, np.minimum(size, 20), np.where(digits == 0, letters, np.minimum(mixed, _SHAPES - 1))).astype(np.int32)


def gap_codes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, row: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """What stands between a token and the one before it in its row: 1 for nothing, 2 and a bit for every class of signs."""
    begin = np.where(np.append(True, row[1:] != row[:-1]), offs[row], np.append(0, ends[:-1]))
    out = np.ones(len(starts), np.int64)
    filled = np.flatnonzero(starts > begin)
    if len(filled):
        edges = np.stack([begin[filled], starts[filled]], 1).ravel()
        out[filled] = 2 + np.bitwise_or.reduceat(np.append(_GAP[buf], np.int16(0)), edges)[::2]
    return out


class Field:
    """A trained chain, with the words and the separators it knows."""

    def __init__(self, words: np.ndarray, gaps: np.ndarray):
        self.words = np.unique(words)
        self.gap_number = np.zeros(_CODES, np.int32)
        self.gap_number[gaps] = np.arange(1, len(gaps) + 1)
        w, g = len(self.words) + 2, len(gaps) + 1
        self.w, self.g = w, g
        self.sizes = (w, w, w, w, _SHAPES**2, _SHAPES**2, _SHAPES**2, g * _SHAPES, g * _SHAPES, g * g, w * _SHAPES, 1)
        self.first = np.concatenate([[0], np.cumsum(self.sizes)])
        self.chain = crf.Chain(int(self.first[-1]), 1 + 2 * len(pii_examples.KINDS))

    def features(self, buf: np.ndarray, starts, ends, row, offs) -> np.ndarray:
        shape = _shapes(buf, starts, ends)
        key = _word_keys(buf, starts, ends)
        word = np.ones(len(starts), np.int32)
        if len(self.words):
            at = np.minimum(np.searchsorted(self.words, key), len(self.words) - 1)
            word = np.where(self.words[at] == key, at + 2, 1).astype(np.int32)
        joined = np.append(row[1:] == row[:-1], False)  # with the token after it
        near, far = joined, np.append(joined[1:] & joined[:-1], False)

        def back(x, by=1):
            """x of the token ``by`` places before, 0 beyond the row."""
            out = np.zeros(len(x), np.int32)
            out[by:] = x[:-by] * (near if by == 1 else far)[:-by]
            return out

        def ahead(x):
            out = np.zeros(len(x), np.int32)
            out[:-1] = x[1:] * near[:-1]
            return out

        gap = self.gap_number[gap_codes(buf, starts, ends, row, offs)]
        after, before, behind, last = ahead(gap), back(shape), ahead(shape), back(word)
        columns = (
            word, last, back(word, 2), ahead(word), before * _SHAPES + shape, shape * _SHAPES + behind, back(shape, 2) * _SHAPES + before,
            gap * _SHAPES + shape, after * _SHAPES + shape, gap * self.g + after, last * _SHAPES + shape, 0,
        )
        out = np.empty((len(starts), len(columns)), np.int32)
        for k, x in enumerate(columns):
            np.add(x, self.first[k], out=out[:, k], casting="unsafe")
        return out

    def spans(self, buf: np.ndarray, offs: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(row, start byte, kind number, end byte) of what the field tags in a run of rows."""
        starts, ends = tb.spans(_TOKEN[buf], offs)
        if not len(starts) or not self.chain.trained:
            return []
        row = tb.rows_of(starts, offs)
        label = self.chain.tag(self.features(buf, starts, ends, row, offs), row)
        out = []
        tagged = np.flatnonzero(label)
        k = 0
        while k < len(tagged):
            t = tagged[k]
            kind, last = (int(label[t]) - 1) // 2, t
            k += 1
            while k < len(tagged) and tagged[k] == last + 1 and row[tagged[k]] == row[t] and label[tagged[k]] == 2 * kind + 2:
                last = tagged[k]
                k += 1
            start = int(starts[t])
            if pii_examples.KINDS[kind] == "phone" and start > offs[row[t]] and buf[start - 1] in b"(+":
                start -= 1
            out.append((int(row[t]), start, kind, int(ends[last])))
        return out


def _sentence_tokens(text: str):
    buf = np.frombuffer(text.encode(), np.uint8)
    offs = np.array([0, len(buf)])
    starts, ends = tb.spans(_TOKEN[buf], offs)
    return buf, offs, starts, ends


def train(labelled: DataFrame, rows: int = 6000, caution: float = 0.75) -> Field:
    """A field from (text, spans) rows: kind, start and end in code points, kinds of ``pii_examples.KINDS``.

    ``caution`` is added to the score of outside when tagging: the labelled table has far more personal data than texts have.
    """
    order = F.xxhash64(F.col("text"))
    sample = labelled.select(F.coalesce("text", F.lit("")).alias("text"), "spans").orderBy(order, "text").limit(rows).collect()
    parsed = [(r["spans"] or [], *_sentence_tokens(r["text"])) for r in sample]
    none = np.zeros(0, np.int64)
    words, count = np.unique(np.concatenate([none.astype(np.uint64), *(_word_keys(b, s, e) for _, b, _, s, e in parsed)]), return_counts=True)
    gaps, times = np.unique(np.concatenate([none, *(gap_codes(b, s, e, np.zeros(len(s), np.int64), o) for _, b, o, s, e in parsed)]), return_counts=True)
    field = Field(words[count > 4], gaps[times > 2][: _SHAPES - 1])
    chains = []
    for spans, buf, offs, starts, ends in parsed:
        if not len(starts):
            continue
        points = code_points(buf, offs)
        label = np.zeros(len(starts), int)
        for s in spans:
            inside = np.flatnonzero((points[starts] < s["end"]) & (points[ends] > s["start"]))
            kind = pii_examples.KINDS.index(s["kind"])
            label[inside], label[inside[:1]] = 2 * kind + 2, 2 * kind + 1
        chains.append((field.features(buf, starts, ends, np.zeros(len(starts), np.int64), offs), label))
    if any(y.any() for _, y in chains):
        field.chain.fit(*crf.windows(chains, 24))
        field.chain.emission[-1, 0] += caution  # of the slot that every token has
    return field


def scan(docs: DataFrame, field: Field) -> DataFrame:
    """docs plus ``spans`` (kind, start, end, value_start), sorted by start, then kind; code points, ends exclusive."""
    shared = docs.sparkSession.sparkContext.broadcast(field)
    kept = [f for f in docs.schema.fields if f.name != "spans"]
    names = [f.name for f in kept]
    wanted = np.zeros(256, bool)
    wanted[[*range(48, 58), ord("@")]] = True

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            found: list[list[dict]] = []
            texts = batch.column("text")
            for start, end, buf, offs in tb.runs(texts):
                tagged: dict[int, list[tuple[int, int, int]]] = {}
                if added := shared.value.spans(buf, offs):
                    points = code_points(buf, offs)
                    for r, s, kind, e in added:
                        zero = points[offs[r]]
                        tagged.setdefault(r, []).append((int(points[s] - zero), len(BASE) + kind, int(points[e] - zero)))
                signs = np.append(0, np.cumsum(wanted[buf]))
                with_signs = signs[offs[1:]] > signs[offs[:-1]]
                for r in range(end - start):
                    base = base_spans(texts[start + r].as_py() or "") if with_signs[r] else []
                    new = [x for x in tagged.get(r, ()) if not any(x[0] < e and s < x[2] for s, _, e in base)]
                    found.append([{"kind": KINDS[k], "start": s, "end": e, "value_start": s} for s, k, e in sorted(base + new)])
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(found, _SPANS_ARROW)], [*names, "spans"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return docs.select(*(F.col(f"`{n}`") for n in names)).mapInArrow(run, f"{schema}, spans {SPANS}")
