"""Secret scan over a trigram inverted index (DataFrame functions only).

Every rule's regular expression gives a Boolean trigram query (an OR of ANDs). The
index holds, for each trigram that a rule can ask for, the documents in which it
occurs. Postings of a clause are intersected by grouping on the document, with the
trigrams as bits of a mask that are combined before the shuffle. The documents left
for a rule are verified with its expression. Rules without a mandatory trigram scan
every text. A document is known by its id and a hash of its text.

Matches are leftmost and do not overlap within a rule; those under the rule's least
length are dropped. Positions are code points, ends exclusive: a text split at the
matches gives the lengths between them, whose running sums are the positions.

Defined cases: a null text is empty; equal rows (id and text) are one document;
different texts of one id are documents of their own; null ids are kept. A text
without match gives one row without spans. Empty tables give no rows. Extra
columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .trigrams import ANY, trigram_query


@dataclass(frozen=True)
class Rule:
    """``at_least`` counts the characters of ``group`` (0: the match) of a found secret.
    ``kept``, where given, matches exactly what ``pattern`` finds of at least that length."""
    name: str
    pattern: str
    group: int = 0
    at_least: int = 1
    kept: str = ""


# The three base rules, then public formats of credentials.
BASE_RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24, r"[0-9a-f]{24,}"),
)
# A key from its BEGIN line to its END line, with no other BEGIN or END line between. Where END is
# missing: to the last base64 line, over headers (Proc-Type: ...); lines are apart by white space,
# quotes or a written-out \\n, hold 16 characters or more but for the last, or a mark of the rules
# above. Repeats are possessive: they have no bound, and the engine runs them without a stack.
_GAP = r"""[\s>"',]*+(?:\\[rn][\s>"',]*+)*+"""
_PRIVATE_KEY = (
    r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----(?:"
    r"[^-]*+(?:-(?!----(?:BEGIN|END) (?:[A-Z]+ )*PRIVATE KEY-----)[^-]*+)*+-----END (?:[A-Z]+ )*PRIVATE KEY-----|"
    rf"(?:{_GAP}[A-Z][A-Za-z-]+:[^\r\n\\]*+(?=[\r\n\\]))*+"
    rf"(?:{_GAP}(?:[A-Za-z0-9+/]{{16,}}+={{0,2}}|[A-Za-z0-9+/]*+\[REDACTED-[A-Z]+\][A-Za-z0-9+/]*+={{0,2}}))++"
    r"(?:(?:\r?\n|\\n)[\x20\t>]*[A-Za-z0-9+/]{1,15}(?:={1,2}|(?=[\r\n\\\"']|$)))?)?")
RULES = BASE_RULES + (
    Rule("private_key", _PRIVATE_KEY),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    Rule("google", r"AIza[0-9A-Za-z_-]+", 0, 39),
    Rule("stripe", r"[rs]k_live_[0-9a-zA-Z]+", 0, 24),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 30),
    Rule("url_login", r"://[A-Za-z0-9._-]+:[^\s:/@]+@", 0, 8),
)


def _documents(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    d = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return d.withColumn("th", F.xxhash64("text"))


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """The inverted index (trigram, doc_id, th) of ``docs`` (doc_id, text, th) for some
    lower-case trigrams."""
    low = docs.select("doc_id", "th", F.lower("text").alias("low"))
    there = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in trigrams]))
    return low.select(F.explode(there).alias("trigram"), "doc_id", "th")


def candidates(docs: DataFrame, rules) -> DataFrame:
    """(doc_id, th, rules): for each document the rules whose trigram query it meets; rules
    without a query are left out."""
    spark = docs.sparkSession
    rows, need = [], []
    for rule in rules:
        query = trigram_query(rule.pattern)
        for c, clause in enumerate(sorted(map(sorted, query)) if query != ANY else []):
            if len(clause) > 60:
                clause = clause[:60]
            need.append((rule.name, c, (1 << len(clause)) - 1))
            rows += [(t, rule.name, c, 1 << i) for i, t in enumerate(clause)]
    if not rows:
        return docs.select("doc_id", "th", F.array().cast("array<string>").alias("rules")).where("false")
    asked = spark.createDataFrame(rows, "trigram string, rule string, clause int, bit long")
    full = spark.createDataFrame(need, "rule string, clause int, full long")
    # both tables are as large as the rules, whatever the input
    met = postings(docs, sorted({r[0] for r in rows})).join(F.broadcast(asked), "trigram") \
        .groupBy("doc_id", "th", "rule", "clause").agg(F.bit_or("bit").alias("bits"))
    met = met.join(F.broadcast(full), ["rule", "clause"]).where(F.col("bits") == F.col("full"))
    return met.groupBy("doc_id", "th").agg(F.array_sort(F.collect_set("rule")).alias("rules"))


def _matches(rule: Rule, kind: int, text: Column) -> Column:
    """array<struct<kind, pos, gap, len, size>>: code points between the last match and this
    one, of the match, and of the group that counts."""
    shape = "array<struct<kind:int,pos:int,gap:int,len:int,size:int>>"
    pattern = rule.kept or rule.pattern
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    sized = F.regexp_extract_all(text, F.lit(pattern), F.lit(rule.group)) if rule.group else found
    gaps = F.transform(F.split(text, pattern, -1), F.char_length)
    each = F.transform(F.arrays_zip(found.alias("f"), sized.alias("s"), gaps.alias("g")), lambda z, i: F.struct(
        F.lit(kind).alias("kind"), i.alias("pos"), z["g"].alias("gap"), F.char_length(z["f"]).alias("len"),
        F.char_length(z["s"]).alias("size")))
    # after the last match there is one more gap
    return F.slice(each, 1, F.size(found)).cast(shape)


def _verified(docs: DataFrame, rules) -> DataFrame:
    """``docs`` (doc_id, text, th) with the names of the rules to verify on each."""
    texts = docs.select("doc_id", "th", F.coalesce("text", F.lit("")).alias("text"))
    c = candidates(texts, rules).select(F.col("doc_id").alias("c_id"), F.col("th").alias("c_th"), "rules")
    return docs.join(c, F.col("doc_id").eqNullSafe(F.col("c_id")) & (F.col("th") == F.col("c_th")), "left").drop("c_id", "c_th")


def _asked(rule: Rule, text: Column) -> Column:
    """Whether the index, or a full scan where there is no query, leaves the text to a rule."""
    listed = F.lit(True) if trigram_query(rule.pattern) == ANY else F.coalesce(F.array_contains("rules", rule.name), F.lit(False))
    return listed & F.rlike(text, F.lit(rule.kept or rule.pattern))


def scan(docs: DataFrame, rules=RULES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, th and spans, array<struct<start, kind, end>> ordered by
    start, then kind, the place of the rule in ``rules``."""
    v = _verified(_documents(docs, doc_id, text), rules)
    none = F.array().cast("array<struct<kind:int,pos:int,gap:int,len:int,size:int>>")
    checks = [F.when(_asked(r, F.col("text")), _matches(r, k, F.col("text"))).otherwise(none) for k, r in enumerate(rules)]
    m = v.select("doc_id", "th", F.explode_outer(F.flatten(F.array(*checks))).alias("m")).select("doc_id", "th", "m.*")
    m = m.dropDuplicates(["doc_id", "th", "kind", "pos"])
    far = Window.partitionBy("doc_id", "th", "kind").orderBy("pos")
    m = m.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(far))
    enough = F.element_at(F.array(*[F.lit(r.at_least) for r in rules]), F.col("kind") + 1)
    span = F.struct((F.col("end") - F.col("len")).alias("start"), F.col("kind"), F.col("end"))
    return m.groupBy("doc_id", "th").agg(F.array_sort(F.collect_list(F.when(F.col("size") >= enough, span))).alias("spans"))


def redact(docs: DataFrame, rules=RULES) -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by its rule's mark, rule after rule, and
    ``n_chars`` (where there is one) as the new length. All rows and columns stay."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    d = docs.select(whole.alias("_doc")).select("_doc", F.col("_doc.doc_id").alias("doc_id"), F.col("_doc.text").alias("text"))
    d = d.withColumn("th", F.xxhash64(F.coalesce("text", F.lit(""))))
    v = _verified(d, rules)
    for rule in rules:
        v = v.withColumn("text", F.when(_asked(rule, F.col("text")), _without(rule, F.col("text"))).otherwise(F.col("text")))
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.coalesce(F.char_length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType)
    return v.select(*[new.get(c, F.col(f"_doc.`{c}`")).alias(c) for c in docs.columns])


def _without(rule: Rule, text: Column) -> Column:
    pattern = rule.kept or rule.pattern
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    sized = F.regexp_extract_all(text, F.lit(pattern), F.lit(rule.group)) if rule.group else found
    mark = F.lit(f"[REDACTED-{rule.name.upper()}]")
    parts = F.transform(F.arrays_zip(F.split(text, pattern, -1).alias("g"), found.alias("f"), sized.alias("s")), lambda z: F.concat(
        z["g"], F.when(z["f"].isNull(), "").when(F.char_length(z["s"]) >= rule.at_least, mark).otherwise(z["f"])))
    return F.array_join(parts, "")
