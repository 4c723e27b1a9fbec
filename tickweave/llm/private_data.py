"""Personal data: pattern spans, and terms that give protected entities away.

Pattern spans (e-mail, IP address, card, phone, and secrets such as passwords
and access tokens) are the protected entities. A term of the same document can
disclose an entity even where that is masked. Corpus counts estimate how much:
with N documents, of which d hold the entity, the entity carries log2(N / d)
bits, and a term in t documents that is in b of its documents carries
log2(N b / (t d)) of those bits. Terms that carry more than GENERALISE of the
entity's information are generalised in the documents that hold it, those
beyond REMOVE are removed.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickweave.llm.common import hide_null, lean, show_null, stage, table

KINDS = ("email", "ip", "card", "phone")
#: A term and an entity count as related from so many documents on; most entities stand in one only.
SUPPORT = 1
GENERALISE, REMOVE = 0.8, 0.95

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
#: What is assigned to a name that speaks of a secret, eight characters or more with a digit among them; or a token of a well-known form.
ASSIGNED = re.compile(r"""(?ai)(?:password|passwd|passphrase|secret|token|(?:api|access|private|auth)[_-]?key)["']?[\x20\t]*[:=][\x20\t]*["']?(?P<value>[^\s"'<>,;]{8,})""")
TOKEN = re.compile(r"(?<![\w-])(?P<value>AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|eyJ[\w-]{10,}\.[\w-]{10,}\.[\w-]{10,})")
#: One of these is in every text that the two can match; most texts hold none.
ASSIGNED_HINTS, TOKEN_HINTS = ("pass", "secret", "token", "key"), ("AKIA", "_", "xox", "eyJ")
SECRET = "secret"
#: Three letters or more; tasks and the JVM read it alike, and both lower a term's case after they have found it.
TERM_PATTERN = r"\p{L}{3,}"
TERM = regex.compile(TERM_PATTERN)


def luhn(digits: str) -> bool:
    total = 0
    for at, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + at % 2)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost, non-overlapping; each @ is looked at once, so long runs cost no more than their length."""
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and LOCAL.match(text, start - 1):
            start -= 1
        if start < at and (domain := DOMAIN.match(text, at + 1)):
            end = domain.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """``start, end, kind`` by start, then kind as listed; matches that fail their test are dropped."""
    found = [(start, end, 0) for start, end in emails(text)]
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in m[0].split(".")):
                found.append((m.start(), m.end(), 1))
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), m.end(), 2))
        for m in PHONE.finditer(text) if "+" in text else ():
            if 10 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                found.append((m.start(), m.end(), 3))
    return [(start, end, KINDS[kind]) for start, end, kind in sorted(found, key=lambda x: (x[0], x[2]))]


def secrets(text: str) -> Iterator[tuple[int, int]]:
    """Values of passwords, keys and access tokens, by start, without overlaps."""
    lower, found = text.lower(), []
    if any(hint in lower for hint in ASSIGNED_HINTS):
        found += [m.span("value") for m in ASSIGNED.finditer(text) if DIGIT.search(m["value"])]
    if any(hint in text for hint in TOKEN_HINTS):
        found += [m.span("value") for m in TOKEN.finditer(text)]
    end = 0
    for start, stop in sorted(found, key=lambda x: (x[0], -x[1])):
        if start >= end:
            yield start, stop
            end = stop


def protected_spans(text: str) -> list[tuple[int, int, str]]:
    """The base spans and those of secrets, by start, then kind."""
    order = {kind: i for i, kind in enumerate((*KINDS, SECRET))}
    return sorted([*base_spans(text), *((start, end, SECRET) for start, end in secrets(text))], key=lambda x: (x[0], order[x[2]]))


def entity(kind: str, value: str) -> str:
    """One name for all spellings of an entity."""
    if kind == SECRET:
        return f"{kind}:{value}"
    return f"{kind}:{value.lower() if kind in ('email', 'ip') else ''.join(c for c in value if '0' <= c <= '9')}"


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def near_terms(text: str, *bounds: int) -> set[str]:
    """Terms of a whole text outside the spans of these starts and ends, which come by start; lower case."""
    pieces, at = [], 0
    for start, end in zip(bounds[::2], bounds[1::2]):
        pieces.append(text[at : max(at, start)])
        at = max(at, end)
    return {term.lower() for piece in (*pieces, text[at:]) for term in TERM.findall(piece)}


def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Spans and entities of each text, and the text itself where it holds an entity: its terms are read and marked later, the others are not met again."""
    for batch in batches:
        out = []
        for doc_id, version, text in zip(batch["doc_id"], batch["version"], batch["text"]):
            text = text or ""
            spans = protected_spans(text)
            kinds = [kind for _, _, kind in spans]
            entities = sorted({entity(kind, text[start:end]) for start, end, kind in spans})
            base = joined([span for span in spans if span[2] != SECRET])
            counts = [kinds.count(kind) for kind in (*KINDS, SECRET)]
            out.append((doc_id, version, *counts, hashlib.sha256(base.encode()).hexdigest(), joined(spans), entities, text if spans else None))
        yield pd.DataFrame(out, columns=["doc_id", "version", *[f"n_{k}" for k in (*KINDS, SECRET)], "base_sha256", "protected", "entities", "text"])


SCANNED = "doc_id long, version long, n_email long, n_ip long, n_card long, n_phone long, n_secret long, base_sha256 string, protected string, entities array<string>, text string"


def list_terms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Terms of each text outside its protected spans."""
    for batch in batches:
        out = []
        for doc_id, version, text, protected in zip(batch["doc_id"], batch["version"], batch["text"], batch["protected"]):
            bounds = [int(x) for span in protected.split(",") for x in span.split(":")[1:]]
            out.append((doc_id, version, sorted(near_terms(text, *bounds))))
        yield pd.DataFrame(out, columns=["doc_id", "version", "terms"])


def terms_of(text: Column) -> Column:
    """Distinct terms of a text, lower case."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TERM_PATTERN), F.lit(0)), F.lower))


def told_pairs(scanned: DataFrame, docs: DataFrame) -> DataFrame:
    """``doc_id, version, entity, term, share``: terms of a document that carry at least GENERALISE of the information of one of its entities.

    All counts are of documents over the whole corpus. With b at most d, only a
    term in at most N^(1 - GENERALISE) d^GENERALISE documents can carry so
    much, so the others leave before they meet the entities of their document.
    """
    total = docs.count()
    row = ["doc_id", "version"]
    holders = scanned.where(F.col("text").isNotNull())
    held = stage(holders.groupBy(*row).agg(F.count("*").alias("copies"), F.first("entities").alias("entities")), "holders")
    own = held.select(*row, "copies", F.explode("entities").alias("entity"))
    entities = own.groupBy("entity").agg(F.sum("copies").alias("d")).where(F.col("d") < total)
    own = stage(own.join(entities, "entity"), "entities")
    used = stage(docs.select(F.explode(terms_of(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("t")), "terms")

    def most(d: Column) -> Column:
        return F.pow(F.lit(float(max(total, 1))), F.lit(1 - GENERALISE)) * F.pow(d, F.lit(GENERALISE)) * (1 + 1e-9)

    reach = own.groupBy(*row).agg(most(F.max("d")).alias("most"))
    listed = holders.select(*row, "text", "protected").mapInPandas(lean(list_terms), "doc_id long, version long, terms array<string>")
    terms = listed.select(*row, F.explode("terms").alias("term")).join(used, "term").join(reach, row).where(F.col("t") <= F.col("most"))
    # a row that is repeated counts by its copies
    terms = terms.drop("most").dropDuplicates([*row, "term"])
    pairs = stage(own.join(terms, row).where(F.col("t") <= most(F.col("d"))), "entity-terms")
    both = pairs.groupBy("entity", "term", "d", "t").agg(F.sum("copies").alias("n")).where(F.col("n") >= SUPPORT)
    near = F.least(F.col("n"), F.col("t"))
    share = F.log2(F.lit(float(total)) * near / (F.col("t") * F.col("d"))) / F.log2(F.lit(float(total)) / F.col("d"))
    shares = both.select("entity", "term", share.alias("share")).where(F.col("share") >= GENERALISE)
    return pairs.select(*row, "entity", "term").join(shares, ["entity", "term"])


def disclosing_terms(scanned: DataFrame, docs: DataFrame) -> DataFrame:
    """``entity, term, share`` of told_pairs, once each."""
    return told_pairs(scanned, docs).select("entity", "term", "share").distinct()


def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Adds the spans of a document's disclosing terms to its protected spans; a term that meets a protected span is left out."""
    order = {k: i for i, k in enumerate((*KINDS, SECRET, "generalise", "remove"))}
    for batch in batches:
        out = []
        for doc_id, version, text, told in zip(batch["doc_id"], batch["version"], batch["text"], batch["told"]):
            text = text or ""
            acts = {x["term"]: "remove" if x["share"] >= REMOVE else "generalise" for x in sorted(told, key=lambda x: x["share"])}
            spans = protected_spans(text)
            starts = [s for s, _, _ in spans]
            # the furthest end of the spans up to each
            ends = list(accumulate((e for _, e, _ in spans), max))
            for m in TERM.finditer(text):
                act = acts.get(m[0].lower())
                if act:
                    at = bisect_left(starts, m.end())
                    if not at or ends[at - 1] <= m.start():
                        spans.append((m.start(), m.end(), act))
            out.append((doc_id, version, joined(sorted(spans, key=lambda x: (x[0], order[x[2]])))))
        yield pd.DataFrame(out, columns=["doc_id", "version", "marked"])


def private_spans(docs: DataFrame) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, n_secret, base_sha256, spans, private`` of every row of ``docs`` (``doc_id, text``).

    ``spans`` lists the base spans, those of secrets and, in documents that
    hold a protected entity, the spans ``generalise`` and ``remove`` of terms
    that disclose it; ``private`` says whether it holds one, of whatever kind.
    A null text counts as empty; repeated rows each give a row and count as
    documents; a null doc_id stays null. Positions are code points. Other
    columns are not read.
    """
    own = docs.select(hide_null(F.col("doc_id")).alias("doc_id"), F.xxhash64("text").alias("version"), "text")
    row = ["doc_id", "version"]
    scanned = stage(own.mapInPandas(lean(scan), SCANNED), "private-spans")
    most = told_pairs(scanned, own).groupBy(*row, "term").agg(F.max("share").alias("share"))
    hit = most.groupBy(*row).agg(F.collect_list(F.struct("term", "share")).alias("told"))
    # only texts that hold an entity are shuffled, few of all
    held = scanned.where(F.col("text").isNotNull()).select(*row, "text")
    texts = held.join(stage(hit, "hits"), row).dropDuplicates(row).select(*row, "text", "told")
    marked = stage(texts.mapInPandas(lean(mark), "doc_id long, version long, marked string"), "marked")
    out = scanned.join(marked, row, "left")
    return out.select(
        show_null(F.col("doc_id")).alias("doc_id"),
        "n_email", "n_ip", "n_card", "n_phone", "n_secret", "base_sha256",
        F.coalesce("marked", "protected").alias("spans"),
        (F.col("protected") != "").alias("private"),
    )


def sanitise(text: str, spans: str) -> str:
    """A text with its spans replaced: entities and generalised terms by their kind in brackets, removed terms by nothing.

    Of spans that overlap the first names the place, and all of them go.
    """
    out, at = [], 0
    for span in filter(None, spans.split(",")):
        kind, start, end = span.split(":")
        if int(start) >= at:
            out += [text[at : int(start)], "" if kind == "remove" else "[term]" if kind == "generalise" else f"[{kind}]"]
        at = max(at, int(end))
    return "".join([*out, text[at:]])


def query(spark, sf_dir: str) -> DataFrame:
    """Spans of every document."""
    return private_spans(table(spark, sf_dir, "documents"))
