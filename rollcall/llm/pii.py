"""Personal data: exact kinds by pattern, and terms that give protected entities away.

Emails, IP addresses, card and phone numbers are found by pattern, with offsets in code
points. Every such value is a protected entity. Names anywhere in a document that holds an
entity (capitalised words that do not only open sentences) are terms. Over the whole corpus
the number of documents of entity e, of term t and of both give the term's disclosure:
the pointwise mutual information of e and t over the information of e, which is 1 when t
occurs only with e. Terms seen with e, and not only opening a sentence, in at least
``SUPPORT`` different texts and in half of e's documents are removed from ``REMOVE`` on and
generalised from ``GENERALISE`` on, at every place in the documents that hold e. Documents
without an entity never change. An entity of fewer texts has no terms: with one text every
rare word of it would be one, and two are mostly near copies.

One pass reads the texts and writes spans, entities and, of texts with an entity, the terms
with their places. Entities and terms of fewer texts than ``SUPPORT`` fall out before terms
meet entities; counts are Spark aggregates with partial sums, and the tables that are joined
are written first, so AQE splits a value in a third of all rows. Spans depend on the text
alone, so equal texts share one row of terms.

Null text counts as empty and has no spans; redaction leaves it null. Repeated rows give
repeated rows, an empty table an empty one. Only ``doc_id`` and ``text`` are read; redaction
keeps all other columns as they are.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.workdir import settle

KINDS = ("email", "ip", "card", "phone", "term")
SUPPORT = 3
SHARE = 0.5
GENERALISE = 0.75
REMOVE = 0.9
# Fixed values of the contract. Possessive parts and the look-behind leave matches as they are but end failing ones at once.
LOCAL = re.compile(r"[A-Za-z0-9._%+-]*")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGIT = re.compile("[^0-9]+")
TERM = r"(?<![\p{L}\p{N}])\p{Lu}\p{Ll}+(?![\p{L}\p{N}])"
OPENING = re.compile(r"(?:^|[.!?:;|\n\"'(«¿¡-])\s*$")
SPAN = "struct<start:int,kind:int,end:int>"
TERMS = "struct<term:string,named:boolean,starts:array<int>>"
SCHEMA = f"doc_id long, text_key string, spans array<{SPAN}>, entities array<string>, terms array<{TERMS}>"


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches: for each @ the run of local characters before it, then the domain."""
    found, at, free = [], text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and LOCAL.fullmatch(text[start - 1]):
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            found.append((start, domain.end()))
        free = domain.end() if domain else at + 1
        at = text.find("@", free)
    return found


def _luhn(digits: str) -> bool:
    return sum(int(d) if i % 2 == 0 else (2 * int(d) - 9 * (d > "4")) for i, d in enumerate(reversed(digits))) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the exact kinds, in order."""
    found = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        digits = NOT_DIGIT.sub("", m[0])
        if 14 <= len(digits) <= 19 and _luhn(digits):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


def entity(text: str, span: tuple[int, int, int]) -> str:
    """The protected value in one spelling."""
    start, kind, end = span
    value = text[start:end].lower()
    return f"{KINDS[kind]}:{NOT_DIGIT.sub('', value) if kind > 1 else value}"


def terms_of(text: str, spans: list[tuple[int, int, int]], term) -> list[dict]:
    """Every term outside the spans with its places, and whether one does not open a sentence; ``term`` is the compiled pattern."""
    found: dict[str, dict] = {}
    taken, at = [], -1
    for start, _, end in spans:
        if end > at:
            taken.append((max(start, at), end))
            at = end
    i = 0
    for m in term.finditer(text):
        a, b = m.span()
        while i < len(taken) and taken[i][1] <= a:
            i += 1
        if i < len(taken) and taken[i][0] < b:
            continue
        of_term = found.setdefault(m[0], {"term": m[0], "named": False, "starts": []})
        of_term["starts"].append(a)
        of_term["named"] = of_term["named"] or not OPENING.search(text[max(0, a - 8) : a])
    return list(found.values())


def scan(docs: DataFrame) -> DataFrame:
    """Base spans, entities and, where there are entities, terms of every row; ``text_key`` stands for the text."""

    def run(batches):
        import regex

        term = regex.compile(TERM)
        for batch in batches:
            keys, spans, entities, terms = [], [], [], []
            for text in batch.column(1).to_pylist():
                text = text or ""
                keys.append(hashlib.md5(text.encode()).hexdigest())
                found = base_spans(text)
                spans.append([{"start": a, "kind": k, "end": b} for a, k, b in found])
                entities.append(sorted({entity(text, s) for s in found}))
                terms.append(terms_of(text, found, term) if found else [])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).cast(pa.int64()),
                    pa.array(keys, pa.string()),
                    pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))),
                    pa.array(entities, pa.list_(pa.string())),
                    pa.array(terms, pa.list_(pa.struct([("term", pa.string()), ("named", pa.bool_()), ("starts", pa.list_(pa.int32()))]))),
                ],
                names=["doc_id", "text_key", "spans", "entities", "terms"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def disclosing_terms(docs: DataFrame, scanned: DataFrame, entities: DataFrame, terms: DataFrame) -> DataFrame:
    """(entity, term, disclosure, action) of the terms that give an entity away.

    ``entities`` (``text_key``, ``copies``, ``entity``) and ``terms`` (``text_key``, ``term``, ``named``) are written tables.
    """
    n = scanned.count()
    enough = F.count("*") >= SUPPORT
    per_entity = settle(entities.groupBy("entity").agg(F.sum("copies").alias("n_entity"), enough.alias("enough")).filter("enough").drop("enough"), "entities")
    candidates = settle(terms.filter("named").groupBy("term").agg(enough.alias("enough")).filter("enough").select("term"), "candidates")
    held = settle(entities.join(per_entity, "entity").select("text_key", "copies", "entity"), "held")
    said = settle(terms.join(candidates, "term").select("text_key", "term", "named"), "said")
    per_pair = (
        held.join(said, "text_key").groupBy("entity", "term")
        .agg(F.sum("copies").alias("n_pair"), (F.count_if("named") >= SUPPORT).alias("enough")).filter("enough").drop("enough")
    )
    per_term = (
        docs.select(F.explode(F.array_distinct(F.regexp_extract_all(F.col("text").cast("string"), F.lit(TERM), F.lit(0)))).alias("term"))
        .groupBy("term").agg(F.count("*").alias("n_term"))
    )
    information = F.log2(F.lit(float(max(n, 1))) / F.col("n_entity"))
    shared = F.log2(F.col("n_pair") * float(max(n, 1)) / (F.col("n_entity") * F.col("n_term").cast("double")))
    disclosure = F.when(information > 0, shared / information).otherwise(F.lit(0.0))
    return (
        per_pair.join(per_entity, "entity").filter(F.col("n_pair") >= SHARE * F.col("n_entity")).join(per_term, "term")
        .withColumn("disclosure", disclosure).filter(F.col("disclosure") >= GENERALISE)
        .select("entity", "term", "disclosure", F.when(F.col("disclosure") >= REMOVE, "remove").otherwise("generalise").alias("action"))
    )


def term_spans(docs: DataFrame, scanned: DataFrame) -> DataFrame:
    """One row per text with disclosing terms: ``text_key`` and their spans with the action."""
    counted = scanned.filter(F.size("entities") > 0).select("text_key", F.explode("entities").alias("entity")).groupBy("text_key", "entity").agg(F.count("*").alias("copies"))
    entities = settle(counted, "held")
    places = settle(scanned.filter(F.size("terms") > 0).dropDuplicates(["text_key"]).select("text_key", F.explode("terms").alias("t")).select("text_key", "t.*"), "places")
    flagged = settle(disclosing_terms(docs, scanned, entities, places.drop("starts")), "terms")
    wanted = settle(entities.join(flagged, "entity").groupBy("text_key", "term").agg(F.max("action").alias("action")), "wanted")
    return (
        places.join(wanted, ["text_key", "term"]).select("text_key", "term", "action", F.explode("starts").alias("start"))
        .groupBy("text_key").agg(F.array_sort(F.collect_list(F.struct(
            "start", F.lit(KINDS.index("term")).alias("kind"), (F.col("start") + F.length("term")).cast("int").alias("end"), "action"
        ))).alias("terms"))
    )


def find_personal_data(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text_key``, base ``spans`` and the spans of disclosing ``terms``."""
    scanned = settle(scan(docs), "pii")
    terms = term_spans(docs, scanned)
    return scanned.select("doc_id", "text_key", "spans").join(terms, "text_key", "left")


def report(docs: DataFrame) -> DataFrame:
    """Counts per kind and the spans as text, one row per document."""

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")

    def shown(spans):
        names = F.array(*[F.lit(k) for k in KINDS])
        return F.concat_ws(",", F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])))

    plain = F.transform("terms", lambda t: F.struct(t["start"].alias("start"), t["kind"].alias("kind"), t["end"].alias("end")))
    every = F.concat(F.col("spans"), F.coalesce(plain, F.array().cast(f"array<{SPAN}>")))
    return find_personal_data(docs).select(
        "doc_id", count("email"), count("ip"), count("card"), count("phone"),
        F.sha2(shown(F.col("spans")), 256).alias("base_sha256"), shown(every).alias("spans"),
    )


def redact_text(text: str, terms: list[dict]) -> str:
    """Base spans become their kind in angle brackets, terms ``<NAME>`` or nothing."""
    spans = [(a, b, f"<{KINDS[k].upper()}>") for a, k, b in base_spans(text)]
    spans += [(t["start"], t["end"], "" if t["action"] == "remove" else "<NAME>") for t in terms]
    out, at = [], 0
    for start, end, shown in sorted(spans):
        if start >= at:
            out += [text[at:start], shown]
        at = max(at, end)
    return "".join(out) + text[at:]


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with all its columns, personal data replaced in ``text``.

    A base span inside or across an earlier one goes with it. ``n_chars``, where there is
    one, follows the text.
    """
    scanned = settle(scan(docs), "pii")
    terms = term_spans(docs, scanned)
    replace = F.pandas_udf(_redact_all, "string")
    found = docs.join(terms.withColumnRenamed("text_key", "_text_key").withColumnRenamed("terms", "_terms"), F.md5(F.coalesce(F.col("text"), F.lit(""))) == F.col("_text_key"), "left")
    out = found.withColumn("text", replace(F.col("text"), F.col("_terms"))).drop("_text_key", "_terms")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)


def _redact_all(texts, terms):
    import pandas as pd

    def known(value):
        return [] if value is None or not hasattr(value, "__len__") else value

    return pd.Series([None if t is None else redact_text(t, known(x)) for t, x in zip(texts, terms, strict=True)], index=texts.index, dtype=object)
