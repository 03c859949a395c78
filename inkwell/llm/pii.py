"""Personal data by bootstrapped contextual extraction.

Candidates are all strings that look like an identifier at all: whole runs of
groups of digits, or of letters and digits, between single blanks or
separators, or something around an @.  The whole run is judged first: what
stands within one is a candidate only if it isn't certainly none by itself, and
is reported only if the run is not.  Seeds are the few that are certain by
themselves (a card number with a right check digit, an address that parses);
counterexamples are those that certainly aren't (short counts, decimals,
version numbers, dates).  A candidate has lexical patterns: its shape, its
shape after the word to the left, its shape before the word to the right, and
with these words also its shape without separators, as the same identifier is
grouped in many ways, and the two words to the left and the one to the right
whatever its shape, as identifiers come in shapes that no seed has.  Words are
looked for within REACH characters.

Patterns and instances form a graph that Spark scores in rounds, until no instance changes its kind.  A pattern's
confidence in a kind is the weight of that kind's instances, over that and the
counterexamples it draws, smoothed; an instance that is no seed weighs what its
patterns say together (noisy-or), once they pass MIN_CONFIDENCE.  So patterns
learned from seeds discover identifiers that no rule knows, and these teach
further patterns.  The graph is a table in the shared folder; only counts by
distinct instance are shuffled, never texts.

Defined results: null and empty texts give no row; whole texts are searched.
Repeated rows are reported as often as they occur, and count once in the graph,
which holds distinct instances.  A null doc_id is reported with a null.  Where
two kinds tie, the first by name is taken.  start and end count characters.
Identifiers are returned as shape and fingerprint, not in clear.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kernel import mapped, written

MIN_CONFIDENCE = 0.6
REACH = 40
SMOOTHING = 1.0
LIKELY = r"[0-9]|@"
CANDIDATE = re.compile(
    r"[\w.+%-]+@[\w-]+(?:\.[\w-]+)+"
    r"|(?<![\w@.,:/-])(?:\d{4}(?: \d{4}){3}|\+\d{1,3}(?: \d{2,5}){2,5}|0\d{1,4}(?: \d{3,8}){1,3})(?![\w@])"
    r"|(?<![\w@])(?:\+\d{1,3}[ .-]?)?(?:\(\d{1,5}\)[ .-]?)?\d(?:[\d./:,-]*\d)?(?![\w@])"
    r"|(?<![\w@])(?=[\w-]*\d)[A-Za-z]{1,3}[\d-]{5,}(?![\w@])"
)
GROUP = r"[A-Za-z]*\d[A-Za-z0-9]*"
SEPARATOR = r"(?:\)[ .-]?|[ .-]?\(|[./:,-]+| )"
RUN = re.compile(
    rf"(?<![\w@])(?:\+ ?)?\(?(?:[A-Za-z]{{1,3}}-+|[0-9A-Fa-f]{{1,4}}::?(?=[0-9A-Fa-f]{{1,4}}:))?{GROUP}"
    rf"(?:{SEPARATOR}{GROUP}|::?[0-9A-Fa-f]{{1,4}}(?![A-Za-z0-9])|[ -][A-Z]{{1,4}}(?=[ -]?\d))*(?![\w@])"
)
EMAIL = re.compile(r"[a-z0-9](?:[\w.+%-]*[a-z0-9])?@(?:[a-z0-9](?:[a-z0-9-]*[a-z0-9])?\.)+[a-z]{2,24}\Z", re.I)
PHONE = re.compile(r"(?:\+1[ .-]?)?(?:\([2-9]\d\d\) |[2-9]\d\d[.-])[2-9]\d\d[.-]\d{4}\Z|\+[2-9]\d{8,13}\Z")
WORD = re.compile(r"[^\W\d_]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c)
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def certain(s: str) -> str | None:
    """The kind that s certainly is, "none" where it certainly is none, or None where only patterns can tell."""
    if "@" in s:
        return "email" if EMAIL.match(s) else None
    digits = re.sub(r"\D", "", s)
    if PHONE.match(s):
        return "phone"
    if re.fullmatch(r"\d{1,3}(?:\.\d{1,3}){3}", s):
        return "ip" if all(int(x) < 256 and (x == "0" or x[0] != "0") for x in s.split(".")) else None
    if 15 <= len(digits) <= 19 and re.fullmatch(r"\d+|\d{4}(?:[ -]\d{4}){3}", s) and digits[0] in "3456" and luhn(digits):
        return "card"
    if re.fullmatch(r"\d{13,19}|\d{4}(?:[ -]\d{4}){3}", s):
        return "none"  # a card number's check digit is never wrong
    if re.fullmatch(r"[1-8]\d\d-\d\d-\d{4}", s):
        return "national_id"
    if len(digits) <= 4 or re.fullmatch(r"\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+[.,]\d+|\d+(?:\.\d+){2}|\d{1,4}[/-]\d{1,2}[/-]\d{1,4}|\d{1,2}(?::\d\d){1,2}", s):
        return "none"
    return None


def shape(s: str) -> str:
    """Runs of digits as D and their length, of letters and digits around an @ as w, the rest as it is."""
    if "@" in s:
        local, _, domain = s.partition("@")
        return "w@" + ".".join("w" for _ in domain.split("."))
    return re.sub(r"[^\W\d_]+", "a", re.sub(r"\d+", lambda m: "9" if "." in s and len(m[0]) < 4 else f"9{{{len(m[0])}}}", s))


def squeezed(s: str) -> str:
    """The shape without what separates groups."""
    return shape(re.sub(r"[ ()./:,+-]", "", s))


def spans(text: str) -> list[tuple[int, int, str | None]]:
    """(start, end, run) of each candidate by place; run is the longer one it stands in, if any."""
    out: list[tuple[int, int, str | None]] = []
    parts = [(m.start(), m.start() + len(m[0].rstrip(".-,:/"))) for m in CANDIDATE.finditer(text)]
    runs, k = [m.span() for m in RUN.finditer(text)], 0
    for start, end in parts:
        while k < len(runs) and runs[k][1] <= start:
            out.append((*runs[k], None))
            k += 1
        if k < len(runs) and runs[k][0] <= start and end <= runs[k][1]:
            a, b = runs[k]
            if (start, end) != (a, b) and certain(text[start:end]) != "none":
                out.append((start, end, text[a:b]))
            continue
        while k < len(runs) and runs[k][0] < end:  # a run within the part, or across its edge
            k += 1
        out.append((start, end, None))
    return sorted([*out, *((a, b, None) for a, b in runs[k:])], key=lambda x: (x[0], -x[1]))


def candidates(text: str) -> list[tuple[int, int, str, str, str, str | None]]:
    """(start, end, string, one or two words to the left, right word, run around it) of each candidate of a text."""
    out = []
    for start, end, run in spans(text):
        left = [w.lower() for w in WORD.findall(text[max(0, start - REACH) : start])]
        right = WORD.search(text, end, end + REACH)
        out.append((start, end, text[start:end], " ".join(left[-2:]) or "^", right[0].lower() if right else "$", run))
    return out


def fingerprint(s: str) -> str:
    return hashlib.sha256(s.lower().encode()).hexdigest()[:24]


def occurrences(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, start, end, instance, shape, seed, patterns, run) of each candidate; instance and run are fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, t in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                for start, end, s, left, right, around in candidates(t):
                    form, loose, both, left = shape(s), squeezed(s), left, left.rpartition(" ")[2]
                    rows.append((i, start, end, fingerprint(s), form, certain(s), [form, f"{left} {form}", f"{form} {right}", f"{left} ~{loose}", f"~{loose} {right}", *([f"{both} * {right}"] if " " in both and right != "$" else [])], around and fingerprint(around)))
            columns = [*zip(*rows)] or [[]] * 8
            types = [batch.column("id").type, pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["id", "start", "end", "instance", "shape", "seed", "patterns", "run"])

    schema = T.StructType([T.StructField("id", docs.schema[key].dataType)])
    for name, kind in (("start", T.IntegerType()), ("end", T.IntegerType()), ("instance", T.StringType()), ("shape", T.StringType()), ("seed", T.StringType()), ("patterns", T.ArrayType(T.StringType())), ("run", T.StringType())):
        schema.add(name, kind)
    return docs.where(docs[text].rlike(LIKELY)).select(docs[key].alias("id"), docs[text].alias("text")).transform(mapped, run, schema)


def score(found: DataFrame, rounds: int | None = None, least: float = MIN_CONFIDENCE) -> DataFrame:
    """(instance, kind, confidence): what each instance is held to be after the rounds.

    Without a number of rounds they go on until the kinds are those of some
    earlier round: the last, or where kinds alternate for ever one before it.
    """
    spark = found.sparkSession
    edges = written(spark, found.select("instance", "seed", F.explode("patterns").alias("pattern")).distinct(), "pii-edges")
    seeds = edges.where("seed is not null").select("instance", F.col("seed").alias("kind"), F.lit(1.0).alias("weight")).distinct()
    open_edges = edges.where("seed is null").select("instance", "pattern")
    held, seen = seeds, set()
    while rounds is None or len(seen) < rounds:
        told = edges.select("instance", "pattern").join(held, "instance").groupBy("pattern", "kind").agg(F.sum("weight").alias("weight"))
        bad = told.where("kind = 'none'").select("pattern", F.col("weight").alias("bad"))
        of_pattern = told.where("kind <> 'none'").groupBy("pattern").agg(F.sum("weight").alias("all"))
        rated = told.where("kind <> 'none'").join(of_pattern, "pattern").join(bad, "pattern", "left")
        rated = rated.withColumn("confidence", F.col("weight") / (F.col("all") + F.coalesce("bad", F.lit(0.0)) + SMOOTHING)).where(F.col("confidence") >= least)
        grown = open_edges.join(rated.select("pattern", "kind", "confidence"), "pattern").groupBy("instance", "kind").agg((1 - F.exp(F.sum(F.log(1 - F.col("confidence"))))).alias("weight"))
        best = grown.groupBy("instance").agg(F.max_by(F.struct("kind", "weight"), F.struct("weight", F.expr("-ascii(kind)"))).alias("b")).select("instance", "b.kind", "b.weight").where(F.col("weight") >= least)
        held = written(spark, seeds.unionByName(best), "pii-scores")
        kinds = tuple(held.agg(F.count("*"), F.expr("bit_xor(xxhash64(instance, kind))")).first())
        if kinds in seen:
            break
        seen.add(kinds)
    return held.where("kind <> 'none'").withColumnRenamed("weight", "confidence")


def find_pii(docs: DataFrame, key: str = "doc_id", text: str = "text", rounds: int | None = None, least: float = MIN_CONFIDENCE) -> DataFrame:
    """(doc_id, start, end, kind, confidence, discovered, shape, fingerprint), a row for each identifier."""
    found = written(docs.sparkSession, occurrences(docs, key, text), "pii-occurrences")
    held = score(found, rounds, least)
    rows = found.join(held, "instance").join(held.select(F.col("instance").alias("run")), "run", "left_anti")
    return rows.select(F.col("id").alias("doc_id"), "start", "end", "kind", "confidence", F.col("seed").isNull().alias("discovered"), "shape", F.col("instance").alias("fingerprint"))
