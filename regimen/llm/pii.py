"""Information-theoretic sanitisation of personal data.

Base spans are emails, IPv4 addresses, card numbers (Luhn) and phone numbers by fixed patterns. Their
values are the protected entities. Terms (words of letters, ASCII lower-cased) within ``reach`` words
of an entity are its context. Over all documents Spark counts how many hold an entity (e), a term (t),
and the term in the entity's context (e, t). A term discloses an entity to the degree
    PMI(e; t) / IC(e),   PMI = log2(N n(e,t) / (n(e) n(t))),   IC = log2(N / n(e)),
the share of the entity's information that the term gives away. Every pair from one shared document on
is judged: terms are generalised from the degree ``generalise`` on and removed from ``remove`` on, in the
entity's contexts. Few shared documents are weak evidence, so the counts of a pair that shares fewer than
``support`` are smoothed: its term counts as if ``support`` more documents held it. How rare the term is then
decides: one that stands nowhere else, by an entity of one document, has the degree
1 - log2(1 + support) / log2(N). The method only adds spans: base spans stay as they are.

Positions count code points, ends are exclusive. A base match whose check fails is dropped and not
tried again; kinds are matched independently. All patterns run in time linear in the text. Null texts
count as empty. Rows that share a doc_id are told apart by their text; wholly equal rows are one
document for the counts and get the same result each. Empty tables give no rows.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from regimen.llm import arrays
from regimen.llm.frames import bitmap_of, maybe_in, stored, text_key

#: the order of kinds in outputs; the first four are base kinds
KINDS = ("email", "ip", "card", "phone", "generalised", "removed")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TERM = re.compile("[A-Za-z\u0080-\U0010FFFF]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

_TERM_BYTES = np.zeros(256, np.uint8)
_TERM_BYTES[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """An email is the run of local characters before an @ (after the last match) and the domain behind it."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            end = domain.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def _luhn(digits: str) -> bool:
    doubled = [int(d) for d in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(2 * d - 9 * (d > 4) for d in doubled)) % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all base spans, by kind as listed, then start."""
    found = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return found
    found += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p[-4:]) <= 255 for p in m.group().split("."))]
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and _luhn(digits):
            found.append(("card", m.start(), m.end()))
    if "+" in text:
        found += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_DIGIT.findall(m.group())) <= 15]
    return found


def _hashes(words: list[bytes]) -> np.ndarray:
    """The hashes of words, as the counting pass makes them."""
    data = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words]).astype(np.int64)
    return arrays.span_hashes(arrays.prefix_sums(data), np.concatenate(([0], ends[:-1])).astype(np.int64), ends)


def contexts(text: str, spans: list[tuple[str, int, int]], reach: int) -> list[tuple[int, int, int, int]]:
    """(entity, term, start, end) of the nearest ``reach`` terms on each side of each span that touch no span, however
    far they are. The text's terms are found once."""
    found: list[tuple[bytes, str, int, int]] = []
    places = [m.span() for m in _TERM.finditer(text)] if spans else []
    starts, ends = [a for a, _ in places], [b for _, b in places]
    touched: set[int] = set()
    for _, a, b in spans:
        touched.update(range(bisect.bisect_right(ends, a), bisect.bisect_left(starts, b)))
    for kind, a, b in spans:
        value = text[a:b].lower() if kind == "email" else "".join(_DIGIT.findall(text[a:b])) if kind != "ip" else text[a:b]
        entity = f"{kind}:{value}".encode()
        before, after = bisect.bisect_right(ends, a), bisect.bisect_left(starts, b)
        for k in (*range(max(0, before - reach), before), *range(after, min(len(places), after + reach))):
            if k not in touched:
                found.append((entity, text[slice(*places[k])].translate(_LOWER), *places[k]))
    if not found:
        return []
    entity = _hashes([e for e, _, _, _ in found]).view(np.int64).tolist()
    term = _hashes([t.encode() for _, t, _, _ in found]).view(np.int64).tolist()
    return [(e, t, a, b) for e, t, (_, _, a, b) in zip(entity, term, found)]


_MENTION = pa.struct([("entity", pa.int64()), ("term", pa.int64()), ("from", pa.int32()), ("to", pa.int32())])
_SPAN = pa.struct([("kind", pa.int32()), ("from", pa.int32()), ("to", pa.int32())])


def scanned(docs: DataFrame, reach: int = 5) -> DataFrame:
    """(doc_id, t, base, mentions) per row: base spans, and the contexts of their entities."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, mentions = [], []
            for value in batch.column("text"):
                text = value.as_py() or ""
                spans = base_spans(text)
                base.append([{"kind": KINDS.index(k), "from": a, "to": b} for k, a, b in spans])
                mentions.append([{"entity": e, "term": t, "from": a, "to": b} for e, t, a, b in contexts(text, spans, reach)] if spans else [])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("t"), pa.array(base, pa.list_(_SPAN)), pa.array(mentions, pa.list_(_MENTION))],
                                             names=["doc_id", "t", "base", "mentions"])

    text = F.col("text").cast("string")
    source = docs.select("doc_id", text_key(text).alias("t"), text.alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, t long, base array<struct<kind:int,from:int,to:int>>, "
                                  "mentions array<struct<entity:long,term:long,from:int,to:int>>")


#: (term, count) entries that a counting task holds before it hands them on
HELD = 1 << 20


def _summed(terms: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct terms with their summed counts."""
    term, place = np.unique(np.concatenate([np.zeros(0, np.uint64), *terms]), return_inverse=True)
    total = np.zeros(len(term), np.int64)
    np.add.at(total, place, np.concatenate([np.zeros(0, np.int64), *counts]))
    return term, total


def repeated(docs: DataFrame) -> DataFrame:
    """(text, more): every row that stands several times wholly equal, once, with the number of its further copies. Only ids and
    hashes of all rows are shuffled; texts only of rows that a bitmap of the repeated ones lets pass."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).withColumn("t", text_key(F.col("text")))
    key = F.xxhash64("doc_id", F.col("doc_id").isNull(), "t")
    several = stored(rows.groupBy("doc_id", "t").agg(F.count("*").alias("n")).where("n > 1").select(key.alias("k")))
    return (maybe_in(rows.withColumn("k", key), "k", bitmap_of(several, "k")).groupBy("doc_id", "t")
            .agg(F.first("text").alias("text"), (F.count("*") - 1).alias("more")).where("more > 0").select("text", "more"))


def term_counts(docs: DataFrame, terms: DataFrame, copies: DataFrame) -> DataFrame:
    """(term, n): in how many documents of the whole corpus each of ``terms`` stands; the further copies of repeated rows
    (``copies``) are taken off. A task sums up the counts of its documents, as far as ``HELD`` entries go, and all
    tasks' counts are summed by term before they meet ``terms``, which are dealt by term too."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, list] = [], []

        def handed_on() -> pa.RecordBatch:
            term, n = _summed(*held)
            return pa.RecordBatch.from_arrays([pa.array(term.view(np.int64)), pa.array(n)], names=["term", "n"])

        for batch in batches:
            offsets, data = arrays.buffer_of(batch.column("text"))
            weight = batch.column("weight").to_numpy()
            for low, _, o, d in arrays.slices(offsets, data):
                upper = (d >= 65) & (d <= 90)
                lowered = d + upper.astype(np.uint8) * np.uint8(32)
                starts, ends, first = arrays.word_bounds(o, lowered, _TERM_BYTES)
                words = arrays.span_hashes(arrays.prefix_sums(lowered), starts, ends)
                owner = np.repeat(np.arange(len(o) - 1), np.diff(first))
                order = np.lexsort((owner, words))
                words, owner = words[order], owner[order]
                new = np.ones(len(words), bool)
                new[1:] = (words[1:] != words[:-1]) | (owner[1:] != owner[:-1])
                held[0].append(words[new])
                held[1].append(weight[low + owner[new]])
                if sum(map(len, held[0])) > HELD:
                    term, n = _summed(*held)
                    held = [term], [n]
                    if len(term) > HELD // 2:
                        yield handed_on()
                        held = [], []
        yield handed_on()

    rows = docs.select(F.col("text").cast("string").alias("text"), F.lit(1).cast("long").alias("weight"))
    rows = rows.unionByName(copies.select("text", (-F.col("more")).cast("long").alias("weight")))
    return rows.mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).join(terms, "term")


def disclosures(docs: DataFrame, found: DataFrame, support: int, generalise: float, smoothed: bool = False) -> DataFrame:
    """(entity, term, degree) of the terms that disclose an entity to the degree ``generalise`` or more: of those that
    share ``support`` documents or more with it, and if ``smoothed`` also of all others, by smoothed counts."""
    copies = stored(repeated(docs))
    total = docs.count() - (copies.agg(F.sum("more")).first()[0] or 0)
    pairs = found.where(F.size("mentions") > 0).select("doc_id", "t", F.explode("mentions").alias("m")).select("doc_id", "t", "m.entity", "m.term").distinct()
    both = stored(pairs.groupBy("entity", "term").agg(F.count("*").alias("n_both")).where(F.col("n_both") >= (1 if smoothed else support)))
    entities = pairs.select("doc_id", "t", "entity").distinct().groupBy("entity").agg(F.count("*").alias("n_entity"))
    terms = term_counts(docs, stored(both.select("term").distinct()), copies).withColumnRenamed("n", "n_term")
    information = F.log2(F.lit(float(total)) / F.col("n_entity"))
    holders = F.greatest("n_term", "n_both") + F.when(F.col("n_both") < support, support).otherwise(0)
    shared = F.log2(F.lit(float(total)) * F.col("n_both") / (F.col("n_entity") * holders))
    return (both.join(entities, "entity").join(terms, "term").where(information > 0)
            .select("entity", "term", (shared / information).alias("degree")).where(F.col("degree") >= generalise))


def spans(docs: DataFrame, reach: int = 5, support: int = 3, generalise: float = 0.7, remove: float = 0.9) -> DataFrame:
    """(doc_id, t, spans) per row of ``docs``: structs of kind (place in ``KINDS``), from and to, sorted."""
    found = stored(scanned(docs, reach))
    degrees = disclosures(docs, found, support, generalise, smoothed=True)
    mentions = (found.where(F.size("mentions") > 0).select("doc_id", "t", F.explode("mentions").alias("m"))
                .select("doc_id", "t", "m.entity", "m.term", "m.from", "m.to"))
    added = (mentions.join(degrees, ["entity", "term"]).groupBy("doc_id", "t", "from", "to").agg(F.max("degree").alias("degree"))
             .select("doc_id", "t", F.struct(F.when(F.col("degree") >= remove, KINDS.index("removed")).otherwise(KINDS.index("generalised")).alias("kind"),
                                             "from", "to").alias("s"))
             .groupBy("doc_id", "t").agg(F.collect_set("s").alias("added")).withColumnsRenamed({"doc_id": "__d", "t": "__t"}))
    joined = found.join(added, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("t") == F.col("__t")), "left")
    return joined.select("doc_id", "t", F.sort_array(F.concat("base", F.coalesce("added", F.array()))).alias("spans"))


def _listed(items: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.concat_ws(",", F.transform(items, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["from"].cast("string"), s["to"].cast("string"))))


def report(docs: DataFrame, **settings) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, n_generalised, n_removed, base_sha256, spans, per row of ``docs``."""
    def count(k: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")

    counts = [count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    base = F.filter("spans", lambda s: s["kind"] < 4)
    return spans(docs, **settings).select("doc_id", *counts, F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))


def sanitise(docs: DataFrame, **settings) -> DataFrame:
    """``docs`` with base spans replaced by their kind in brackets, generalised terms by ``[TERM]`` and removed terms left out."""
    marks = ["[EMAIL]", "[IP]", "[CARD]", "[PHONE]", "[TERM]", ""]
    found = spans(docs, **settings).dropDuplicates(["doc_id", "t"]).withColumnsRenamed({"doc_id": "__d", "t": "__t", "spans": "__s"})
    text = F.col("text").cast("string")
    joined = docs.join(found, F.col("doc_id").eqNullSafe(F.col("__d")) & (text_key(text) == F.col("__t")), "left")

    @F.pandas_udf("string")
    def replaced(texts, lists):
        out = []
        for value, items in zip(texts, lists):
            if value is None or items is None or len(items) == 0:
                out.append(value)
                continue
            parts, at = [], 0
            for s in sorted(items, key=lambda s: (s["from"], -s["to"])):
                if s["to"] > at:                     # where spans overlap, the first one's mark stands for all
                    if s["from"] >= at:
                        parts += [value[at:s["from"]], marks[s["kind"]]]
                    at = s["to"]
            out.append("".join([*parts, value[at:]]))
        return texts.__class__(out, dtype=object)

    return joined.select(*(replaced(text, "__s").alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns))
