"""Secret scans: patterns propose candidates, a random forest removes false positives.

Candidates are runs of key-like characters and whole private key blocks. Each is described by its length, its character
transitions, how much of it the corpus's own words cover, its path (whether it is part of a path or address) and its neighbouring
words. The forest is trained by Spark's own RandomForestClassifier on labelled findings, and its trees become one SQL
expression, so scoring is built-in functions throughout.

Where nobody has labelled findings, weak_labels() does. It looks only at what the forest is not given: the issuer's format
and the name that stands directly before a finding.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldmark.llm._shared import small, staged
from foldmark.llm._spans import matches

BLOCK = r"-----BEGIN [A-Z\x20]{0,40}PRIVATE KEY-----[A-Za-z0-9+/=\s]*+-----END [A-Z\x20]{0,40}PRIVATE KEY-----"
#: A private key block, or a run of key characters, 12 or more.
CANDIDATE = rf"{BLOCK}|(?<![A-Za-z0-9_/+.-])[A-Za-z0-9_/+.-]{{12,}}+={{0,2}}(?![A-Za-z0-9_/+])"
#: A name directly before a value, with = or : between them and perhaps quotes.
NAMED = r"(?i)(?:secret|token|passw(?:or)?d|pwd|api_?key|access_?key|private_?key|auth|credential)[A-Za-z0-9_.-]{0,20}[\"']?\s{0,3}[=:]\s{0,3}[\"']?\z"
ASSIGNED = r"[A-Za-z_][A-Za-z0-9_.-]{0,40}[\"']?\s{0,3}[=:]\s{0,3}[\"']?\z"
PLAIN_NAME = r"(?i)(?:commit|sha-?[0-9]{1,3}|md5|checksum|digest|uuid|guid|revision|integrity|etag|version|hash|build|src|href|url|path|file)[A-Za-z0-9_.-]{0,20}[\"']?\s{0,3}[=:]?\s{0,3}[\"']?\z"
PLAIN_VALUE = r"^(?:[0-9+.-]+[A-Za-z]{0,3}|[A-Za-z]+(?:[-./_][A-Za-z]+)*|[A-Za-z0-9_/-]+(?:\.[A-Za-z0-9_-]+)*\.(?:com|org|net|io|edu|gov|eu|de|fr|es|uk|html?|php|js|css|py|md|txt|pdf|png|jpe?g|gif|svg|json|xml|csv|zip))$"
NEAR_WORDS = r"(?i)\b(?:secret|token|password|passwd|key|credential|bearer|login|auth)\b"
HARMLESS = r"(?i)\b(?:commit|sha1|sha256|md5|checksum|digest|uuid|revision|example|sample|dummy|hash|integrity)\b"
#: Issuers' prefixes, which alone make a finding certain: fixed values of public key formats.
KNOWN = r"^(?:AKIA[A-Z0-9]{16}|ASIA[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35}|[sr]k_live_[A-Za-z0-9]{20,}|eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\..*|-----BEGIN [\s\S]*)$"
CONTEXT = 40
#: Labelled findings of which the forest learns at most; the sample is by a hash of the finding.
TRAIN_ROWS = 8000
FEATURES = ("length", "transitions", "digits", "upper", "words", "distinct", "path", "near", "harmless", "prose")
#: Documents that must hold a word before it counts as one, and a word that stands for itself in a text.
WORD_DOCS = 5
WORD = r"(?<![A-Za-z0-9_/+=.-])[A-Za-z]{3,}+(?![A-Za-z0-9_/+=-])"


def candidates(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """keep and, for each candidate of each whole text, start, end (code points), finding, before and after."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(*keep, F.explode(matches(text, CANDIDATE, _shaped, CONTEXT, after=True)).alias("hit"))
    return rows.select(*keep, "hit.start", "hit.end", F.col("hit.text").alias("finding"), "hit.before", "hit.after")


def _shaped(s: Column, before: Column) -> Column:
    """Keys mix digits with letters, or hold an = or a change of case inside; plain words and numbers never do and are taken
    only where a secret's name stands before them."""
    return s.rlike(r"[A-Za-z]") & (s.rlike(r"[0-9=]|[a-z][A-Z]|[A-Z]{2}[a-z]|^-----BEGIN ") | before.rlike(NAMED))


def _value(s: Column) -> Column:
    return F.regexp_replace(s, r"^[A-Za-z_]+=", "")


def covered(found: DataFrame, docs: DataFrame, text_col: str = "text") -> DataFrame:
    """found with words, the share of each finding's characters in runs of 3 letters or more that are words of the corpus.

    A word is one that WORD_DOCS documents or more hold by itself. Only runs that findings hold are counted, over all documents.
    found has a column cid that tells its rows apart.
    """
    parts = found.select("cid", F.explode(F.regexp_extract_all(_value(F.col("finding")), F.lit("[A-Z]?[a-z]{2,}|[A-Z]{3,}"), F.lit(0))).alias("part"))
    parts = staged(parts.select("cid", F.lower("part").alias("part"), F.length("part").alias("n")).filter("n >= 3"), "parts")
    known = staged(parts.select("part").distinct(), "part-words")
    held = docs.select(F.explode(F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD), F.lit(0)), F.lower))).alias("part"))
    words = held.join(small(known), "part", "left_semi").groupBy("part").count().filter(F.col("count") >= WORD_DOCS).select("part")
    share = staged(parts.join(small(staged(words, "dictionary")), "part", "left_semi").groupBy("cid").agg(F.sum("n").alias("of_words")), "coverage")
    words = F.coalesce(F.col("of_words"), F.lit(0)) / F.greatest(F.length(_value(F.col("finding"))), F.lit(1))
    return found.join(small(share), "cid", "left").withColumn("words", words).drop("of_words")


def described(found: DataFrame) -> DataFrame:
    """found (with words) with a column f_<feature> for each of FEATURES, as doubles, never null, and known and named,
    which are kept from the forest."""
    s, before, after = F.col("finding"), F.coalesce(F.col("before"), F.lit("")), F.coalesce(F.col("after"), F.lit(""))
    value = _value(s)
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[0-9]", "0"), "[A-Z]", "A"), "[a-z]", "a"), "[^0Aa]", "-")
    n = F.greatest(F.length(value), F.lit(1)).cast("double")
    share = lambda pattern: F.regexp_count(value, F.lit(pattern)) / n
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    around = F.concat(F.regexp_replace(before, ASSIGNED, " "), F.lit(" "), after)  # without the name directly before
    values = {
        "length": n,
        "transitions": F.regexp_count(F.regexp_replace(kinds, r"(.)\1*+", "."), F.lit(r"\.")) / n,
        "digits": share("[0-9]"),
        "upper": share("[A-Z]"),
        "words": F.col("words"),
        "distinct": F.size(F.array_distinct(F.split(value, ""))) / n,
        "path": flag(s.rlike(r"/.*/|^www\.") | before.rlike(r"[@/\\]$|://\S*$") | after.rlike(r"^@")),
        "near": flag(around.rlike(NEAR_WORDS)),
        "harmless": flag(around.rlike(HARMLESS)),
        "prose": F.least(F.regexp_count(around, F.lit(r"\b[a-z]{2,}\b")) / 10.0, F.lit(1.0)),
    }
    more = {"known": value.rlike(KNOWN), "named": before.rlike(NAMED) | F.regexp_extract(s, r"^[A-Za-z_]+=", 0).rlike(NAMED)}
    return found.withColumns({f"f_{k}": F.coalesce(v.cast("double"), F.lit(0.0)) for k, v in values.items()} | more)


def weak_labels(found: DataFrame) -> DataFrame:
    """Labelled findings where no human has labelled any: issuers' formats and values assigned to a secret's name are secrets;
    values directly after the name of a digest, version or address are not, nor are numbers with a unit, joined words and names of
    hosts and files that no name with = or : stands before; the rest stays without a label and out of the training."""
    assigned = F.col("before").rlike(ASSIGNED)
    no = F.col("before").rlike(PLAIN_NAME) | (~assigned & F.col("finding").rlike(PLAIN_VALUE))
    label = F.when(F.col("known") | F.col("named"), 1.0).when(no, 0.0)
    return found.withColumn("label", label).filter("label IS NOT NULL")


class Forest:
    """A random forest on FEATURES as one SQL expression."""

    def __init__(self, expression: str):
        self.expression = expression

    @classmethod
    def fit(cls, labelled: DataFrame, trees: int = 12, depth: int = 5, rows: int = TRAIN_ROWS, seed: int = 2) -> Forest:
        """labelled: described findings with label 0.0 or 1.0. Learns from at most `rows` of them, the least by a hash of
        finding and context. With no or one class only, what is known or named scores 1 and all else 0."""
        from pyspark.ml.classification import RandomForestClassifier
        from pyspark.ml.feature import VectorAssembler

        names = [f"f_{k}" for k in FEATURES]
        sample = labelled.select(*names, F.col("label").cast("double").alias("label"), F.xxhash64("finding", "before").alias("h")).filter(F.col("label").isNotNull())
        sample = staged(sample.orderBy("h", *names, "label").limit(rows), "findings").coalesce(1)
        if sample.select("label").distinct().count() < 2:
            return cls("CASE WHEN known OR named THEN 1.0D ELSE 0.0D END")
        data = VectorAssembler(inputCols=names, outputCol="features").transform(sample)
        model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed).fit(data)
        return cls("(" + " + ".join(cls._sql(t._call_java("rootNode"), names) for t in model.trees) + f") / {float(trees)}D")

    @classmethod
    def _sql(cls, node, names: list[str]) -> str:
        if node.getClass().getSimpleName() == "LeafNode":
            stats = list(node.impurityStats().stats())
            return f"{stats[1] / max(sum(stats), 1e-12)!r}D"
        split = node.split()
        return f"(CASE WHEN {names[split.featureIndex()]} <= {split.threshold()!r}D THEN {cls._sql(node.leftChild(), names)} ELSE {cls._sql(node.rightChild(), names)} END)"


def findings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All candidates of docs, described, staged."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = staged(candidates(rows, ["doc_id"]).withColumn("cid", F.monotonically_increasing_id()), "candidates")
    return staged(described(covered(found, rows)), "findings")


def scan(docs: DataFrame, labelled: DataFrame | None = None, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Secrets in every whole text: doc_id, start, end, finding, score (0 to 1), secret (score >= threshold).

    labelled: findings with columns finding, before, after and label (0 or 1); without it weak_labels() of docs serve. What
    has an issuer's format scores 1 whatever the forest says. Null and empty texts have no candidates; a document listed
    twice is scanned twice. Other columns are not read; an empty table gives an empty result.
    """
    found = findings(docs, id_col, text_col)
    if labelled is not None:
        given = staged(labelled.select("finding", "before", "after", F.col("label").cast("double").alias("label")).withColumn("cid", F.monotonically_increasing_id()), "labelled")
        labelled = described(covered(given, docs, text_col))
    forest = Forest.fit(weak_labels(found) if labelled is None else labelled)
    return scored(found, forest, threshold).select("doc_id", "start", "end", "finding", "score", "secret")


def scored(found: DataFrame, forest: Forest, threshold: float = 0.5) -> DataFrame:
    """Described findings with score and secret."""
    rows = found.withColumn("score", F.round(F.when(F.col("known"), 1.0).otherwise(F.expr(forest.expression)), 6))
    return rows.withColumn("secret", F.col("score") >= threshold)


def held_out_quality(labelled: DataFrame, threshold: float = 0.5) -> tuple[float, float, int]:
    """Precision and recall of the forest alone, and the number of findings, on the quarter of the described, labelled findings
    by a hash of the finding that it has not learnt from; a finding that repeats is on one side only."""
    part = F.pmod(F.xxhash64("finding"), F.lit(4))
    forest = Forest.fit(labelled.filter(part != 0))
    got = labelled.filter(part == 0).select("label", (F.expr(forest.expression) >= threshold).alias("yes"))
    hit, said, true, n = got.agg(F.count_if(F.col("yes") & (F.col("label") == 1)), F.count_if("yes"), F.count_if(F.col("label") == 1), F.count(F.lit(1))).first()
    return hit / max(1, said), hit / max(1, true), n
