"""Secret scan: expressions propose strings, a random forest removes false positives.

All of it is DataFrame expressions: candidates and their neighbouring words come from one expression over the whole
text, features from string functions, and the forest is Spark ML's, fitted on labelled findings.
"""

from __future__ import annotations

from pyspark.ml import Model
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What is glued to the front of a candidate, and the candidate.
CANDIDATE = r"(^|[^A-Za-z0-9+/_=:-]|[=:])([A-Za-z0-9+/_-]{16,})"
#: A shorter value with any characters, up to a quote or white space, that is assigned to a key word; closing marks are not its own.
ASSIGNED = (r"(?i)(?:token|pass|pwd|secret|key|api|auth|cred|bearer|private)[a-z0-9_.\[\]-]*[\"'`]?\s*(?:=>|:=|[=:])\s*[\"'`]?"
            r"((?!https?:)[^\s\"'`]{5,}[^\s\"'`,;.)\]}])[\"'`]?[,;.)\]}]*$")
KEYWORD = r"(?i)(token|pass|pwd|secret|key|api|auth|cred|bearer|private)"
TESTING = r"(?i)(test|example|sample|mock|fixture|doc|lock|vendor)"
#: Findings that a forest is fitted on at most, the first by a hash of the candidate.
FIT_ROWS = 20_000
#: Words of the dictionary: the most frequent short words of the corpus.
DICTIONARY = 150
FEATURES = ("length", "digits", "uppers", "lowers", "vowels", "marks", "digit_letter", "letter_digit", "lower_upper", "upper_lower",
            "doubled", "others", "hex", "covered", "keyword", "assigned", "quoted", "near_words", "testing_path", "path_depth", "path_group")


def candidates(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str = "source") -> DataFrame:
    """One row per candidate: key, its number (2^31 times the word it stands in, and the number in that word), path, the
    two words before, what is glued to its front, and the candidate.

    Candidates are runs of 16 or more key characters, and, in words without such a run, values of 6 characters or more
    that are assigned to a key word. Null and empty texts have none; repeated rows give theirs each; a null path is empty.
    """
    words = docs.select(F.col(key).alias("key"), F.coalesce(F.col(path), F.lit("")).alias("path"),
                        F.split(F.coalesce(F.col(text), F.lit("")), r"\s+").alias("words"))

    def assigned(w: Column, i: Column) -> Column:
        last = F.coalesce(F.get("words", i - 1), F.lit(""))
        return (F.length(w) >= 6) & (F.contains(w, F.lit("=")) | F.contains(w, F.lit(":")) | F.endswith(last, F.lit("=")) | F.endswith(last, F.lit(":")))

    # only words that may hold a candidate leave the row, with their place
    wanted = F.filter(F.transform("words", lambda w, i: F.when((F.length(w) >= 16) | assigned(w, i), F.struct(i.alias("i"), w.alias("w")))),
                      lambda x: x.isNotNull())
    found = words.withColumn("wanted", wanted).select(
        "key", "path", F.explode(F.transform("wanted", lambda x: F.struct(
            x["i"].alias("i"), x["w"].alias("w"),
            F.array_join(F.slice("words", F.greatest(F.lit(1), x["i"] - 1), F.least(F.lit(2), x["i"])), " ").alias("before")))).alias("x"))
    runs = F.regexp_extract_all("w", F.lit(CANDIDATE), F.lit(0))
    value = F.regexp_extract(F.concat_ws(" ", "before", "w"), ASSIGNED, 1)
    # a value that begins in a word before is no value of this word
    own = F.when((value != "") & F.contains("w", value), F.array(value)).otherwise(F.array().cast("array<string>"))
    each = found.select("key", "path", "x.*").select(
        "key", "path", "i", "w", "before", runs.alias("runs"), own.alias("own")).select(
        "key", "path", "i", "w", "before", (F.size("runs") > 0).alias("run"), F.posexplode(F.when(F.size("runs") > 0, F.col("runs")).otherwise(F.col("own"))).alias("n", "m"))
    front = F.when(F.col("run"), F.length(F.regexp_extract("m", "^[^A-Za-z0-9+/_-]?", 0))).otherwise(0)
    return each.select("key", (F.col("i").cast("long") * 2**31 + F.col("n")).alias("n"), "path", "before",
                       F.left("w", F.greatest(F.lit(0), F.instr("w", F.col("m")) + front - 1)).alias("glue"),
                       F.when(F.col("run"), F.regexp_extract("m", CANDIDATE, 2)).otherwise(F.col("m")).alias("candidate"))


def dictionary(docs: DataFrame, text: str = "text", size: int = DICTIONARY) -> list[str]:
    """The most frequent words of three to five letters in all documents, ties in alphabetical order."""
    words = docs.select(F.explode(F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"(?<![a-z0-9])[a-z]{3,5}(?![a-z0-9])"), F.lit(0))).alias("word"))
    top = words.groupBy("word").count().orderBy(F.desc("count"), "word").limit(size).collect()
    return [r["word"] for r in top]


def features(found: DataFrame, words: list[str]) -> DataFrame:
    c = F.col("candidate")
    length = F.length(c).cast("double")

    def times(pattern: str, of: Column = c) -> Column:
        return F.regexp_count(of, F.lit(pattern)).cast("double")

    def flag(of: Column, pattern: str) -> Column:
        return of.rlike(pattern).cast("double")

    known = "|".join(sorted(words, key=lambda w: (-len(w), w))) or "(?!)"
    values = {
        "length": F.log1p(length), "digits": times("[0-9]") / length, "uppers": times("[A-Z]") / length,
        "lowers": times("[a-z]") / length, "vowels": times("[aeiouAEIOU]") / length, "marks": times("[+/_-]") / length,
        "digit_letter": times("[0-9](?=[A-Za-z])") / length, "letter_digit": times("[A-Za-z](?=[0-9])") / length,
        "lower_upper": times("[a-z](?=[A-Z])") / length, "upper_lower": times("[A-Z](?=[a-z])") / length,
        "doubled": times(r"(.)(?=\1)") / length, "others": times("[^A-Za-z0-9+/_-]") / length, "hex": flag(c, "^(?=.*[0-9])[0-9a-fA-F]+$"),
        "covered": 1 - F.length(F.regexp_replace(F.lower(c), known, "")) / length,
        "keyword": flag(F.concat("before", "glue"), KEYWORD), "assigned": flag(F.concat("before", "glue"), r"[=:]\s*[\"']?$"),
        "quoted": flag(F.col("glue"), "[\"']"), "near_words": times(r"\S+", F.col("before")),
        "testing_path": flag(F.col("path"), TESTING), "path_depth": times("/", F.col("path")),
        "path_group": F.pmod(F.xxhash64("path"), F.lit(16)).cast("double"),
    }
    return found.select("*", *[values[n].alias(n) for n in FEATURES])


def fit(labelled: DataFrame, label: str = "label", rows: int = FIT_ROWS, trees: int = 24, depth: int = 7) -> Model | float:
    """A forest over at most `rows` labelled findings; the share of label 1 where there are not two classes."""
    wanted = (labelled.where(F.col(label).isNotNull()).select(*FEATURES, F.col(label).cast("double").alias("label"), "candidate")
              .orderBy(F.xxhash64("candidate"), "candidate", *FEATURES).limit(rows))
    seen = wanted.agg(F.count("*").alias("n"), F.sum("label").alias("ones")).first()
    if not seen["n"] or seen["ones"] in (0.0, float(seen["n"])):
        return (seen["ones"] or 0.0) / max(1, seen["n"])
    assembled = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(wanted)
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=7, featureSubsetStrategy="sqrt").fit(assembled.select("features", "label"))


def score(found: DataFrame, model: Model | float) -> DataFrame:
    """Adds the probability of being a secret."""
    if isinstance(model, float):
        return found.withColumn("score", F.lit(model))
    assembled = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(found)
    return model.transform(assembled).withColumn("score", vector_to_array("probability")[1]).drop(
        "features", "rawPrediction", "probability", "prediction")


def rule_label(found: DataFrame) -> DataFrame:
    """Labelled findings where no reviewed ones exist: 1 for known key formats and for random-looking strings assigned to
    a key word, 0 for plain numbers, for strings without digits that no key word stands before and for short values of
    lower-case letters only, null otherwise."""
    c = F.col("candidate")
    random = (F.col("digits") > 0.1) & (F.col("digits") < 0.95)
    secret = c.rlike("^(AKIA|ASIA)[A-Z0-9]{16}$|^gh[pousr]_[A-Za-z0-9]{30,}$") | ((F.col("keyword") == 1) & (F.col("assigned") == 1) & random)
    plain = c.rlike("^[0-9]+$") | (~c.rlike("[0-9]") & (F.col("keyword") == 0)) | c.rlike("^[a-z]{1,15}$")
    return found.withColumn("label", F.when(secret, 1).when(plain, 0))
