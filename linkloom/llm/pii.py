"""Information-theoretic sanitisation of personal data.

Base: e-mail addresses, IP addresses, card and phone numbers by pattern. Method: the corpus tells how strongly
a term beside such an entity reveals it. With n(e, t) the occurrences of term t beside mentions of entity e,
n(t) its occurrences in the corpus (outside of mentions), and p(e) the share of all terms that stand beside e,

    PMI(e, t) = log2((n(e, t) / n(t)) / p(e)),  IC(e) = -log2 p(e),  disclosure = PMI / IC

is 1 if t occurs beside e only, and 0 if it is independent. A passage is judged by the others: of c different contexts
of a pair c - 1 speak for it, so n(e, t) is weighed by (c - 1) / c. One context alone proves nothing, two cost one bit,
and many cost next to nothing; there is no least number. A term is any run of letters and digits. Different documents with the same line are different contexts, as
are different passages of one document; copies of a document, edited ones too, count once as a rule. Terms at or
above a threshold are generalised to their kind (name, number, code, word), and from a second threshold on removed, wherever they
stand in a document that mentions the entity which they would reveal.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_right
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .runtime import Scratch, small

KINDS = ("email", "ip", "card", "phone", "term")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_DIGIT = re.compile(r"[0-9]")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TERM = re.compile(r"[^\W_]+")
_NOT_DIGIT = re.compile(r"[^0-9]")
#: Code points on each side of a mention, over line breaks, that count as beside it, if not told otherwise.
REACH = 200
#: Min-hashes of a context; two contexts differ if all of them differ.
_FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches, in linear time: each @ is looked at once."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        lo = at
        while lo > done and text[lo - 1] in _LOCAL:
            lo -= 1
        if lo < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((lo, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all base matches, sorted; kind is an index into KINDS, offsets are code points."""
    if not text:
        return []
    out = [(s, 0, e) for s, e in _emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split(".")):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            digits = _NOT_DIGIT.sub("", m.group())
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


def _minima(words: list[str]) -> np.ndarray:
    """Minima over the word pairs by each of ``_FACTORS``: edited copies mostly share some of them."""
    pairs = np.fromiter({zlib.crc32(f"{a} {b}".encode("utf-8", "replace")) for a, b in zip(["", *words], [*words, ""])}, np.uint32)
    return (pairs[:, None] * _FACTORS).min(0)


def _contexts(text: str, spans: list[tuple[int, int, int]], reach: int = REACH) -> list[dict]:
    """For each mention: its entity, min-hashes of the document and the words around it, and the terms beside it that
    no earlier mention of the entity has."""
    lows, highs = _merged(spans)
    out, seen = [], set()
    document = _minima(text.split()).astype(np.int64) << 32
    for s, kind, e in spans:
        value = text[s:e].lower() if kind < 2 else _NOT_DIGIT.sub("", text[s:e])
        from_, to = max(0, s - reach), min(len(text), e + reach)
        at = bisect_right(highs, from_)  # the first stretch of mentions that isn't over; terms come in order, and so do stretches
        entity, terms = hashlib.blake2b(f"{KINDS[kind]}:{value}".encode(), digest_size=16).hexdigest(), []
        for m in _TERM.finditer(text, from_, to):
            a, b = m.span()
            while at < len(highs) and highs[at] <= a:
                at += 1
            whole = (a == 0 or not text[a - 1].isalnum()) and (b == len(text) or not text[b].isalnum())
            if whole and (entity, a) not in seen and not (at < len(lows) and lows[at] < b):
                seen.add((entity, a))
                terms.append(m.group().lower())
        around = document | _minima([*text[from_:s].split(), "", *text[e:to].split()])
        out.append({"entity": entity, "around": around.tolist(), "terms": terms})
    return out


def _merged(spans: list[tuple[int, int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the stretches that sorted spans cover; spans that only touch are apart."""
    lows, highs = [], []
    for s, _, e in spans:
        if highs and s < highs[-1]:
            highs[-1] = max(highs[-1], e)
        else:
            lows.append(s)
            highs.append(e)
    return lows, highs


def _inside(text: str, spans: list[tuple[int, int, int]]) -> list[str]:
    """Terms that lie in a mention, in part or as a whole: sanitised with it, so they are no occurrences of their own."""
    out, done = [], 0
    for s, e in zip(*_merged(spans)):
        s = max(s, done)  # up to there the terms are told
        while s > done and text[s - 1].isalnum():
            s -= 1
        e = max(e, s)
        while e > done and e < len(text) and text[e].isalnum():
            e += 1
        out += [m.group().lower() for m in _TERM.finditer(text, s, e)]
        done = max(done, e)
    return out


_SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("kind", T.IntegerType()), T.StructField("end", T.IntegerType())])
_CONTEXT = T.StructType([T.StructField("entity", T.StringType()), T.StructField("around", T.ArrayType(T.LongType())), T.StructField("terms", T.ArrayType(T.StringType()))])
_ARROW_SPAN = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
_ARROW_CONTEXT = pa.list_(pa.struct([("entity", pa.string()), ("around", pa.list_(pa.int64())), ("terms", pa.list_(pa.string()))]))


def _detect(docs: DataFrame, text: str, carry: list[str], reach: int) -> DataFrame:
    """carry's columns, a number for each row, its base spans, and where it has any the text and the contexts."""
    fields = [T.StructField("_pii_row", T.LongType()), *[docs.schema[c] for c in carry], T.StructField("_pii_base", T.ArrayType(_SPAN)), T.StructField("_pii_contexts", T.ArrayType(_CONTEXT)), T.StructField("_pii_inside", T.ArrayType(T.StringType())), T.StructField("_pii_text", T.StringType())]
    rows = docs.select(F.monotonically_increasing_id().alias("_pii_row"), *carry, F.col(text).alias("_pii_text"))

    def run(batches):
        for batch in batches:
            base, contexts, within, texts = [], [], [], []
            for t in batch.column(batch.num_columns - 1).to_pylist():
                spans = base_spans(t)
                base.append([{"start": s, "kind": k, "end": e} for s, k, e in spans])
                contexts.append(_contexts(t, spans, reach) if spans else [])
                within.append(_inside(t, spans) if spans else [])
                texts.append(t if spans else None)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(base, _ARROW_SPAN), pa.array(contexts, _ARROW_CONTEXT), pa.array(within, pa.list_(pa.string())), pa.array(texts, pa.string())],
                names=[f.name for f in fields],
            )

    return rows.mapInArrow(run, T.StructType(fields))


def _count_terms(docs: DataFrame, text: str, inside: DataFrame, wanted: np.ndarray, mask: int) -> DataFrame:
    """Occurrences in all texts, but for those inside mentions, of the terms whose hash is wanted: (term, n_term), partly
    summed by batch. The row of the null term has the number of all terms."""
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(wanted))

    def run(batches):
        keep = np.unpackbits(shared.value).astype(bool)
        for batch in batches:
            found: Counter = Counter()
            for t in batch.column(0).to_pylist():
                if t:
                    found.update(_TERM.findall(t))
            sums: Counter = Counter({None: found.total()})
            for term, n in found.items():
                low = term.lower()
                if keep[zlib.crc32(low.encode("utf-8", "replace")) & mask]:
                    sums[low] += n
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array(list(sums.values()), pa.int64())], ["term", "n"])

    counted = docs.select(text).mapInArrow(run, "term string, n long")
    return counted.unionByName(inside.select(F.explode(F.array("term", F.lit(None))).alias("term"), F.lit(-1).cast("long").alias("n"))).groupBy("term").agg(F.sum("n").alias("n_term"))


def find_personal_data(docs: DataFrame, text: str = "text", carry: list[str] | None = None, generalise_at: float = 0.9, remove_at: float = 0.98, reach: int = REACH, filter_bits: int = 20) -> DataFrame:
    """A row for each document: ``carry``'s columns, ``base`` and ``spans``.

    base: array of (start, kind, end, remove) of the pattern matches; spans: those and the disclosing terms. Terms within
    ``reach`` code points of a mention are counted as beside it; those that disclose an entity are marked in the whole of each text
    that mentions it. Very long texts are taken as a whole.
    kind is an index into KINDS. Null and empty texts have no spans; repeated rows are handled one by one (no
    column needs to be a key); an empty table gives none. Columns named
    _pii_... are reserved; carried ones named base and spans are replaced. What the driver gets is at most 2**filter_bits hash values, at any input size.
    """
    carry = [c for c in (carry if carry is not None else docs.columns) if c not in ("base", "spans") and (carry is not None or c != text)]
    found = _find(docs, text, carry, generalise_at, remove_at, reach, filter_bits)
    return found.withColumnsRenamed({"_pii_marked": "base", "_pii_spans": "spans"})


def _bits(terms: DataFrame, mask: int) -> np.ndarray:
    """Which of mask + 1 hash values the terms have: all that the driver gets of them."""
    out = np.zeros(mask + 1, bool)
    out[terms.select(F.crc32(F.col("term").cast("binary")).bitwiseAND(F.lit(mask)).alias("h")).distinct().toArrow().column("h").to_numpy()] = True
    return out


def _occurrences(found: DataFrame, wanted: np.ndarray, mask: int) -> DataFrame:
    """All places outside of mentions, in the whole text of each document that has a mention, of the terms whose hash is wanted."""
    shared = found.sparkSession.sparkContext.broadcast(np.packbits(wanted))

    def run(batches):
        keep = np.unpackbits(shared.value).astype(bool)
        for batch in batches:
            rows = ([], [], [], [])
            for row, t, base in zip(*(c.to_pylist() for c in batch.columns)):
                spans, at = [(s["start"], s["end"]) for s in base], 0
                done = 0  # the end of all spans before ``at``: they may overlap
                for m in _TERM.finditer(t):
                    low = m.group().lower()
                    while at < len(spans) and spans[at][0] < m.end():
                        done = max(done, spans[at][1])
                        at += 1
                    if done <= m.start() and keep[zlib.crc32(low.encode("utf-8", "replace")) & mask]:
                        for c, v in zip(rows, (row, low, m.start(), m.end())):
                            c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(rows, (pa.int64(), pa.string(), pa.int32(), pa.int32()))], ["_pii_row", "term", "start", "end"])

    return found.where(F.col("_pii_text").isNotNull()).select("_pii_row", "_pii_text", "_pii_base").mapInArrow(run, "_pii_row long, term string, start int, end int")


def _find(docs: DataFrame, text: str, carry: list[str], generalise_at: float = 0.9, remove_at: float = 0.98, reach: int = REACH, filter_bits: int = 20) -> DataFrame:
    """carry's columns, _pii_marked and _pii_spans."""
    scratch = Scratch(docs.sparkSession, "pii")
    found = scratch.table(_detect(docs, text, carry, reach), "found")
    mentions = found.where(F.size("_pii_contexts") > 0).select("_pii_row", F.explode("_pii_contexts").alias("c"))
    beside = mentions.select("_pii_row", F.col("c.entity").alias("entity"), F.col("c.around").alias("around"), F.explode("c.terms").alias("term"))
    # each occurrence beside an entity is here once; a pair of one context only can't disclose, whatever its counts
    n = len(_FACTORS)
    ends = [f(F.col("around")[j]).alias(f"{f.__name__}{j}") for j in range(n) for f in (F.min, F.max)]
    pairs = scratch.table(beside.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n_both"), *ends), "pairs")
    entities = pairs.groupBy("entity").agg(F.sum("n_both").alias("n_entity"))
    differ = F.lit(True)
    for j in range(n):
        differ = differ & (F.col(f"min{j}") != F.col(f"max{j}"))
    several = scratch.table(pairs.where(differ).select("entity", "term", "n_both"), "several")
    contexts = beside.join(small(several.select("entity", "term")), ["entity", "term"]).select("entity", "term", F.posexplode("around").alias("j", "context"))
    contexts = contexts.groupBy("entity", "term", "j", "context").agg(F.lit(1).alias("one")).groupBy("entity", "term", "j").agg(F.count(F.lit(1)).alias("c"))
    likely = scratch.table(several.join(contexts.groupBy("entity", "term").agg(F.min("c").alias("contexts")), ["entity", "term"]), "likely")
    mask = (1 << filter_bits) - 1
    wanted = _bits(likely, mask)
    total = 1
    if wanted.any():
        counts = scratch.table(_count_terms(docs, text, found.select(F.explode("_pii_inside").alias("term")), wanted, mask), "counts")
        total = max(counts.where(F.col("term").isNull()).first()["n_term"], 1)
    bits = -F.log2(F.least(F.lit(0.5), F.col("n_entity") / F.lit(float(total))))
    disclosure = 1 + F.log2(F.least(F.lit(1.0), F.col("n_both") / F.col("n_term")) * (F.col("contexts") - 1) / F.col("contexts")) / bits
    disclosing = (likely.join(counts, "term") if wanted.any() else likely.where(F.lit(False)).withColumn("n_term", F.lit(1))).join(entities, "entity").withColumn("disclosure", disclosure).where(F.col("disclosure") >= generalise_at)
    disclosing = scratch.table(disclosing.select("entity", "term", "disclosure"), "disclosing")
    # what each text's entities make telling comes first, then its places: no place meets an entity that it doesn't reveal
    scratch.keep("found", "disclosing")
    telling = _bits(disclosing, mask)
    places = _occurrences(found if telling.any() else found.where(F.lit(False)), telling, mask)
    told = mentions.select("_pii_row", F.col("c.entity").alias("entity")).distinct().join(small(disclosing), "entity").groupBy("_pii_row", "term").agg(F.max("disclosure").alias("d"))
    extra = places.join(told, ["_pii_row", "term"]).groupBy("_pii_row").agg(F.collect_list(F.struct("start", F.lit(4).alias("kind"), "end", (F.col("d") >= remove_at).alias("remove"))).alias("_pii_extra"))
    base = F.transform("_pii_base", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), F.lit(False).alias("remove")))
    plain = found.where(F.size("_pii_base") == 0).select(*carry, base.alias("_pii_marked"), base.alias("_pii_spans"))
    marked = found.where(F.size("_pii_base") > 0).select("_pii_row", *carry, base.alias("_pii_marked")).join(extra, "_pii_row", "left")
    marked = marked.select(*carry, "_pii_marked", F.when(F.col("_pii_extra").isNull(), F.col("_pii_marked")).otherwise(F.array_sort(F.concat("_pii_marked", "_pii_extra"))).alias("_pii_spans"))
    return plain.unionByName(marked)


def joined(spans: F.Column) -> F.Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def general(term: str) -> str:
    """What a term is generalised to."""
    if term.isnumeric():
        return "NUMBER"
    if any(c.isnumeric() for c in term):
        return "CODE"
    return "NAME" if term[0].isupper() else "WORD"


def sanitise(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """docs with each span in the text replaced by its kind in brackets (a disclosing term by the kind of term that it is); strongly
    disclosing terms are removed.

    Overlapping base spans are merged under the first one's kind. All columns and rows stay; rows without a span
    are passed on as they are.
    """
    columns = docs.columns
    spotted = _find(docs, text, columns, **options)
    touched = spotted.where(F.size("_pii_spans") > 0).select(*columns, "_pii_spans")
    at = columns.index(text)

    def run(batches):
        for batch in batches:
            out = []
            for t, spans in zip(batch.column(at).to_pylist(), batch.column(len(columns)).to_pylist()):
                parts, done = [], 0
                for s in spans:
                    if s["start"] >= done:
                        kind = KINDS[s["kind"]].upper() if s["kind"] < 4 else general(t[s["start"] : s["end"]])
                        parts += [t[done : s["start"]], "" if s["remove"] else f"[{kind}]"]
                    done = max(done, s["end"])
                out.append("".join([*parts, t[done:]]))
            arrays = list(batch.columns[:-1])
            arrays[at] = pa.array(out, arrays[at].type)
            yield pa.RecordBatch.from_arrays(arrays, columns)

    return spotted.where(F.size("_pii_spans") == 0).select(*columns).unionByName(touched.mapInArrow(run, docs.schema))
