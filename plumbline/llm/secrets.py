"""Secret scans: a linear-chain conditional random field beside three fixed patterns.

Tokens are runs of characters that secrets are made of. Each is tagged begin, inside or outside from
its shape, its neighbours, what stands between it and the word before, and features of the whole
file; the best tagging is found by Viterbi. The field is trained in numpy, by maximum likelihood
with forward and backward sums, on a labelled table of secrets of many kinds in sentences and of things that only look like
secrets (``secret_examples``), and on what the patterns mark in a sample of documents, where half of the marked windows are
shown without the word before the secret, so that its own shape has to tell. Spans of the
patterns always stay; tagged spans that touch none of them are added under the kind ``crf``.

Sample bounds (training only; scanning covers whole texts, in time proportional to their length): ``sample`` documents by hash,
``windows`` token windows. Corner cases: null and empty texts have no spans; repeated rows are scanned each for itself, a null
doc_id like any other; other columns pass through, but a column named spans is replaced; an empty table gives an empty table.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import crf, secret_examples
from plumbline.llm import textbytes as tb
from plumbline.llm.sampling import first_by_hash

KINDS = ("assign", "access", "hex", "crf")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")

_TOKEN = np.zeros(256, bool)
_TOKEN[[*range(48, 58), *range(65, 91), *range(97, 123), *map(ord, "+/_.-")]] = True
_TOKEN[128:] = True
_HEX_BYTE = np.zeros(256, bool)
_HEX_BYTE[[*range(48, 58), *range(97, 103)]] = True
_CLASS = np.full(256, 8, np.uint8)  # 1 lower, 2 upper, 4 digit, 8 sign, 16 beyond ASCII
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 1, 2, 4, 16
_SIZES = (64, 64, 44, 16, 2048, 2048, 8, 16, 2048, 4096, 4096, 512, 1)
_FIRST = np.concatenate([[0], np.cumsum(_SIZES)])
OUT, BEGIN, INSIDE = 0, 1, 2


def base_spans(text: str, maybe_hex: bool = True) -> list[tuple[int, int, int, int]]:
    """(start, kind number, end, start of the value) of the fixed patterns, in code points, sorted."""
    found = []
    low = text.lower()
    if any(k in low for k in _KEYWORDS):
        found += [(m.start(), 0, m.end(), m.start(2)) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m.start()) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    if maybe_hex:
        found += [(m.start(), 2, m.end(), m.start()) for m in _HEX.finditer(text) if len(m[0]) >= 24]
    return sorted(found)


def tokens(buf: np.ndarray, offs: np.ndarray):
    """(starts, ends, row, feature numbers [token, slot]) of a run of rows."""
    starts, ends = tb.spans(_TOKEN[buf], offs)
    row = tb.rows_of(starts, offs)
    if not len(starts):
        return starts, ends, row, np.zeros((0, len(_SIZES)), np.int32)
    kind = _CLASS[buf]

    def count(mask):
        total = np.zeros(len(buf) + 1, np.int32)
        np.cumsum(mask, out=total[1:])
        return total

    digit, hexed = count(kind == 4), count(_HEX_BYTE[buf])
    turn = np.zeros(len(buf), bool)
    turn[1:] = (kind[1:] == 4) != (kind[:-1] == 4)
    turns = count(turn)
    length = ends - starts
    seen = np.bitwise_or.reduceat(kind, starts)  # also reads the gap behind a token, which holds signs only
    gap_sign = count((kind == 8) & _TOKEN[buf])
    seen = (seen & 23) | (8 * (gap_sign[ends] > gap_sign[starts])).astype(np.uint8)
    digits = digit[ends] - digit[starts]
    all_hex = (hexed[ends] - hexed[starts]) == length
    word = tb.span_hash(tb.prefix_hash(tb.LOWER[buf]), starts, ends)
    code = 1 + (word % np.uint64(2046)).astype(np.int32)
    same = np.zeros(len(starts), bool)
    same[1:] = row[1:] == row[:-1]
    before = np.zeros(len(starts), np.int32)
    before[1:] = np.where(same[1:], code[:-1], 0)
    second = np.zeros(len(starts), np.int32)
    second[2:] = np.where(same[2:] & same[1:-1], code[:-2], 0)
    after = np.zeros(len(starts), np.int32)
    after[:-1] = np.where(same[1:], code[1:], 0)
    gap_from = np.where(same, np.concatenate([[0], ends[:-1]]), offs[row])
    between = np.zeros(len(starts), np.int32)
    for bit, signs in ((1, b"="), (2, b":"), (4, b"\"'`")):
        total = count(np.isin(buf, np.frombuffer(signs, np.uint8)))
        between += bit * (total[starts] > total[gap_from]).astype(np.int32)
    size = np.maximum(np.diff(offs), 1)
    share = np.minimum(7, 40 * (digit[offs[1:]] - digit[offs[:-1]]) // size)
    marked = count(buf == ord("="))
    file_code = share + 8 * ((marked[offs[1:]] - marked[offs[:-1]]) > 0)
    long_class = np.digitize(length, (8, 16, 24))
    shape = (seen + 32 * all_hex).astype(np.int32)
    turned = np.minimum(turns[ends] - turns[np.minimum(starts + 1, ends)], 15)
    upper = count((kind == 2))
    cased = np.minimum(7, np.where(length > 0, 8 * (upper[ends] - upper[starts]) // np.maximum(length, 1), 0))
    columns = (
        np.minimum(length, 63), shape, 10 * digits // length + 11 * long_class, turned, before, after, between, file_code[row], second,
        shape * 64 + np.minimum(length, 63), shape * 64 + 4 * turned + long_class, (8 * between + cased) * 4 + long_class + 256 * (before == 0), 0,
    )
    out = np.empty((len(starts), len(columns)), np.int32)
    for k, x in enumerate(columns):
        np.add(x, _FIRST[k], out=out[:, k], casting="unsafe")
    return starts, ends, row, out


def code_points(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """For each byte position (and the end) the code points before it in the run."""
    out = np.zeros(len(buf) + 1, np.int64)
    np.cumsum((buf & 0xC0) != 0x80, out=out[1:])
    return out


WIDTH = 24


def training_windows(docs: DataFrame, per_doc: int = 8) -> DataFrame:
    """priority, features (int32 bytes), labels (int8 bytes): windows around pattern matches and around look-alikes."""

    def run(batches):
        for batch in batches:
            texts = batch.column("text")
            ids = batch.column("doc_id").to_pylist()
            out: list[tuple[int, bytes, bytes]] = []
            for start, end, buf, offs in tb.runs(texts):
                starts, ends, row, feats = tokens(buf, offs)
                points = code_points(buf, offs)
                cut = np.searchsorted(row, np.arange(end - start + 1))
                for r in range(end - start):
                    a, b = cut[r], cut[r + 1]
                    if a == b:
                        continue
                    label = np.zeros(b - a, np.int8)
                    at, to = points[starts[a:b]] - points[offs[r]], points[ends[a:b]] - points[offs[r]]
                    for _, _, stop, value in base_spans(texts[start + r].as_py() or ""):
                        inside = np.flatnonzero((at < stop) & (to > value) & (label == 0))
                        label[inside], label[inside[:1]] = INSIDE, BEGIN
                    hard = np.flatnonzero((label == BEGIN))
                    look = np.flatnonzero(((feats[a:b, 2] - _FIRST[2]) % 11 > 0) & (label == 0))
                    picked = [*hard[:per_doc], *look[:: max(1, len(look) // per_doc)][:per_doc], *([(b - a) // 2] if ids[start + r] is not None else [])]
                    for p in picked:
                        s = max(0, min(int(p) - WIDTH // 2, b - a - WIDTH))
                        y = label[s : s + WIDTH]
                        out.append((0 if y.any() else 1, feats[a + s : a + s + len(y)].astype("<i4").tobytes(), y.tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], ["priority", "features", "labels"])

    return docs.select("doc_id", "text").mapInArrow(run, "priority int, features binary, labels binary")


def _constructed(rows: list[tuple[str, list[tuple[int, int]]]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(features, labels) of labelled sentences."""
    out = []
    for text, spans in rows:
        buf = np.frombuffer(text.encode(), np.uint8)
        offs = np.array([0, len(buf)])
        starts, ends, _, feats = tokens(buf, offs)
        points = code_points(buf, offs)
        label = np.zeros(len(starts), np.int64)
        for s, e in spans:
            inside = np.flatnonzero((points[starts] < e) & (points[ends] > s))
            label[inside], label[inside[:1]] = INSIDE, BEGIN
        if len(starts):
            out.append((feats, label))
    return out


def train(docs: DataFrame, sample: int = 12_000, windows: int = 3_000, labelled=None, caution: float = 0.5) -> crf.Chain:
    """A field from labelled sentences, by default ``secret_examples``, and windows of a sample of documents.

    ``caution`` is added to the score of outside when tagging: the labelled table has far more secrets than texts have.
    """
    ids = F.broadcast(first_by_hash(docs, sample, 5))  # at most ``sample`` ids
    found = training_windows(docs.select("doc_id", "text").join(ids, "doc_id", "left_semi"))
    rows = found.orderBy("priority", F.xxhash64("features", "labels"), "features").limit(windows).collect()
    chains = _constructed(secret_examples.examples() if labelled is None else labelled)
    for i, r in enumerate(rows):
        y = np.frombuffer(r["labels"], np.int8).astype(np.int64)
        feats = np.frombuffer(r["features"], "<i4").reshape(len(y), -1).copy()
        if y[0] == INSIDE:  # a window may start inside a span
            y[0] = BEGIN
        if i % 2:
            for slot in (4, 8):
                feats[y == BEGIN, slot] = _FIRST[slot]
        chains.append((feats, y))
    chain = crf.Chain(int(_FIRST[-1]), 3)
    if any(y.any() for _, y in chains):
        chain.fit(*crf.windows(chains, WIDTH))
        chain.emission[-1, OUT] += caution  # of the slot that every token has
    return chain


SPANS = "array<struct<kind:string,start:bigint,end:bigint,value_start:bigint>>"
_SPANS_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value_start", pa.int64())]))


def scan(docs: DataFrame, field: crf.Chain) -> DataFrame:
    """docs plus ``spans``, sorted by start, then kind; positions are code points, ends exclusive."""
    shared = docs.sparkSession.sparkContext.broadcast(field)
    kept = [f for f in docs.schema.fields if f.name != "spans"]
    names = [f.name for f in kept]

    def run(batches):
        chain = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            found: list[list[dict]] = []
            texts = batch.column("text")
            for start, end, buf, offs in tb.runs(texts):
                starts, ends, row, feats = tokens(buf, offs)
                label = chain.tag(feats, row)
                hs, he = tb.spans(_HEX_BYTE[buf], offs)
                hexed = set(tb.rows_of(hs[he - hs >= 24], offs).tolist())
                tagged: dict[int, list[tuple[int, int]]] = {}
                prior = np.where(np.append(True, row[1:] != row[:-1]), OUT, np.append(OUT, label[:-1]))[: len(label)]
                begins = np.flatnonzero((label == BEGIN) | ((label == INSIDE) & (prior == OUT)))
                if len(begins):
                    points = code_points(buf, offs)
                    for b in begins:
                        last, r = b, int(row[b])
                        while last + 1 < len(label) and label[last + 1] == INSIDE and row[last + 1] == r:
                            last += 1
                        tagged.setdefault(r, []).append((int(points[starts[b]] - points[offs[r]]), int(points[ends[last]] - points[offs[r]])))
                for r in range(end - start):
                    all_ = base_spans(texts[start + r].as_py() or "", r in hexed)
                    base = list(all_)
                    all_ += [(s, 3, e, s) for s, e in tagged.get(r, ()) if not any(s < x[2] and x[0] < e for x in base)]
                    found.append([{"kind": KINDS[k], "start": s, "end": e, "value_start": v} for s, k, e, v in sorted(all_)])
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(found, _SPANS_ARROW)], [*names, "spans"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return docs.select(*(F.col(f"`{n}`") for n in names)).mapInArrow(run, f"{schema}, spans {SPANS}")


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """Texts of scanned docs with every secret value replaced (overlapping spans by one mark)."""
    step = F.struct(F.lit("").alias("done"), F.lit(0).cast("bigint").alias("at"))

    def add(acc, s):
        begin = F.greatest(s["value_start"], acc["at"])
        piece = F.col("text").substr((acc["at"] + 1).cast("int"), (begin - acc["at"]).cast("int"))
        ended = s["end"] <= acc["at"]
        return F.struct(
            F.when(ended, acc["done"]).otherwise(F.concat(acc["done"], piece, F.when((begin > s["value_start"]) & (acc["at"] > 0), F.lit("")).otherwise(F.lit(mark)))).alias("done"),
            F.greatest(acc["at"], s["end"]).alias("at"),
        )

    folded = F.aggregate("spans", step, add, lambda acc: F.concat(acc["done"], F.col("text").substr((acc["at"] + 1).cast("int"), F.length("text"))))
    return docs.withColumn("text", F.when(F.size("spans") > 0, folded).otherwise(F.col("text")))


def joined(spans, kinds: tuple[str, ...] = KINDS):
    """kind:start:end of the spans of these kinds, comma-joined."""
    mine = F.filter(spans, lambda s: s["kind"].isin(*kinds)) if kinds != KINDS else spans
    return F.concat_ws(",", F.transform(mine, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def count(spans, kind: str):
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")
