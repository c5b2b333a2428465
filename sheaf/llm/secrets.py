"""Secrets in texts: candidates by pattern, false positives removed by a random forest.

A candidate is a private key block; a value of at least ``MIN_VALUE`` characters of any kind behind a
secret's name and a sign of assignment; the password in a URL; or a run of at least ``MIN_LENGTH``
token characters with a digit in it (or a known key prefix). Its features are length, shares and transitions of character
classes, alternation of vowels and consonants, distinct characters, coverage by a dictionary, signs
of a path, and words next to it. The forest is trained on labelled findings and then written out as
one SQL expression, so that scanning is a projection: no shuffle, no model in tasks.

Labelled findings are a parameter, a table of candidates (``c``, ``b``, ``a``: the candidate and what
stands before and after it) with a ``label``. Without one, rules label the candidates of the table
itself: known key forms and assignments to a secret's name are findings; digits alone, words,
paths, and candidates behind names of public identifiers are not; the rest stays unlabelled and is
left to the forest. The forest sees at most ``LABELLED_ROWS`` distinct findings, drawn by hash.

Defined results: a null or empty text has no candidates and stays as it is; with labels of fewer
than two kinds the rules decide; repeated rows give equal results; a null doc_id is kept; an empty
table gives no rows; other columns are untouched.

Only DataFrame and SQL functions are used; the forest is Spark's own.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheaf.llm.common import query, table, written

MIN_LENGTH, MIN_VALUE = 12, 6
LABELLED_ROWS = 20_000
TREES, DEPTH = 20, 6
CONTEXT = 60
THRESHOLD = 0.5
MASK = "[SECRET]"

_KEY_BLOCK = r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----[\s\S]*?-----END [A-Z ]{0,30}PRIVATE KEY-----"
_TOKEN = r"[A-Za-z0-9+/_-]"
#: Prefixes of published key formats (fixed values).
_PREFIX = r"AKIA|ASIA|ghp_|gho_|ghs_|github_pat_|glpat-|xox[abprs]-|sk_live_|rk_live_|AIza|SG_|eyJ"
_NAMES = "secret|token|passw|pwd|api[_-]?key|access[_-]?key|auth|bearer|credential|private[_-]?key|signature"
_PUBLIC = "commit|revision|sha-?1|sha-?256|md5|checksum|etag|digest|uuid|guid|isbn|issn|doi|order|invoice|serial|version|build|example|sample|dummy|placeholder"
#: A value ends before white space, quotes and what ends a phrase. The first test is the cheap one.
_VALUE = rf"[^\s\"'`,;<>]{{{MIN_VALUE - 1},}}(?<=[^\s\"'`,;<>.:)\]}}!?])"
_ASSIGNED = rf"(?<=[=:][\"'`\x20]?[\"'`]?)(?<=(?i:{_NAMES})[\w-]{{0,16}}[\"']?\x20{{0,2}}[=:]\x20?[\"'`]?)(?![=:\"'`\s]){_VALUE}"
_IN_URL = r"(?<=:)(?<=://[^\s/:@]{1,60}:)[^\s/@]{3,}(?=@)"
CANDIDATE = (
    rf"{_KEY_BLOCK}|{_IN_URL}|{_ASSIGNED}"
    rf"|(?<!{_TOKEN})(?={_PREFIX}|[A-Za-z+/_-]{{0,400}}[0-9]){_TOKEN}{{{MIN_LENGTH},}}+={{0,2}}"
)
#: A text without any of these has no candidate.
_HINT = rf"[0-9]|PRIVATE KEY|{_PREFIX}|(?i:{_NAMES})[\w-]{{0,16}}[\"']?\x20{{0,2}}[=:]|://[^\s/:@]+:"

DICTIONARY = (
    "about access admin after agent all and api app archive article asset auth base bin block blog body book build "
    "cache card cat category class client code com common config content core css data date day dev div doc docs "
    "download edit email en end error example feed file files first font for form from get group guide header help "
    "home html http https icon id image images img index info int item js json key lang lib license line link list "
    "local log login main map max media menu min model module name net new news node not null number object of old "
    "on org page part password path php png post private product profile public read report request root run sample "
    "script search secret section server service session set site size source src start static status style system "
    "tag temp test text the theme this thumb time title to token tools top type update upload url user users utils "
    "value version video view web www xml year"
).split()

FEATURES = (
    "length digits uppers transitions alternation distinct hex dictionary slashes dashes in_path named assigned "
    "quoted public known in_url"
).split()


def candidates(text: Column) -> Column:
    """The candidates of a text in order: ``c`` itself, ``b`` and ``a`` the text next to it, and
    ``skip`` the characters since the candidate before."""
    found = F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0))
    gaps = F.split(text, CANDIDATE, -1)
    whole = F.zip_with(
        F.zip_with(found, gaps, lambda c, g: F.struct(c.alias("c"), g.alias("g"))),
        F.slice(gaps, F.lit(2), F.size(gaps)),
        lambda x, after: F.when(x["c"].isNotNull(), F.struct(
            x["c"].alias("c"), F.right(x["g"], F.lit(CONTEXT)).alias("b"),
            F.left(after, F.lit(CONTEXT)).alias("a"), F.length(x["g"]).alias("skip"))),
    )
    none = F.array().cast("array<struct<c:string,b:string,a:string,skip:int>>")
    return F.when(text.rlike(_HINT), F.filter(whole, lambda x: x.isNotNull())).otherwise(none)


def features(x: Column) -> Column:
    """A struct of numbers, in the order of ``FEATURES``."""
    c, b, a = x["c"], x["b"], x["a"]
    n = F.length(c).cast("double")
    low, before = F.lower(c), F.lower(b)
    letters, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    kinds = F.translate(c, letters + letters.upper() + digits, "l" * 26 + "u" * 26 + "d" * 10)
    sounds = F.translate(low, letters, "".join("v" if x in "aeiouy" else "c" for x in letters))
    words = F.filter(F.regexp_extract_all(low, F.lit("[a-z]{2,}"), F.lit(0)),
                     lambda w: w.isin(DICTIONARY))
    flag = lambda x: x.cast("double")
    share = lambda pattern, of: F.regexp_count(of, F.lit(pattern)) / n
    values = (
        n, share("[0-9]", c), share("[A-Z]", c), share("l(?=[ud])|u(?=[ld])|d(?=[lu])", kinds),
        share("v(?=c)|c(?=v)", sounds), F.size(F.array_distinct(F.split(c, ""))) / n,
        flag(c.rlike("^[0-9a-fA-F]+$")),
        F.aggregate(words, F.lit(0), lambda s, w: s + F.length(w)) / n,
        share("/", c), share("[-_]", c),
        flag(b.rlike(r"[/\\][^ \n]*$") | a.rlike(r"^(/|\.[A-Za-z]{2,5}\b)")),
        flag(before.rlike(rf"({_NAMES})[\w-]{{0,16}}[\"']?\s*(=|:|is|:=|=>)?\s*[\"'`]?$")),
        flag(b.rlike(r"[=:]\s*[\"'`]?$")), flag(b.rlike(r"[\"'`]$") & a.rlike(r"^[\"'`]")),
        flag(before.rlike(rf"\b({_PUBLIC})\W{{0,4}}$")),
        flag(c.rlike(rf"^({_PREFIX})|^-----BEGIN")),
        flag(b.rlike(r"://[^\s/:@]+:$") & a.startswith("@")),
    )
    return F.struct(*(v.alias(name) for v, name in zip(values, FEATURES)))


def rule_label(f: Column) -> Column:
    """1 and 0 for what the rules know, else null."""
    mixed = (f["digits"] > 0.1) & (f["digits"] < 1)
    return (
        F.when((f["known"] == 1) & (f["length"] >= 20) & (f["dictionary"] < 0.3), 1)
        .when((f["named"] == 1) & (f["assigned"] == 1) & (mixed | (f["transitions"] > 0.4)) & (f["dictionary"] < 0.3), 1)
        .when((f["in_url"] == 1) & (f["dictionary"] < 0.6), 1)
        .when(f["digits"] == 1, 0)
        .when((f["in_path"] == 1) | (f["public"] == 1) | (f["slashes"] > 0.1), 0)
        .when((f["dictionary"] > 0.4) | (f["digits"] < 0.1) & (f["uppers"] < 0.2), 0)
    )


def _tree_sql(node, at: str) -> str:
    if node.numDescendants() == 0:
        stats = list(node.impurityStats().stats())
        return f"{stats[1] / sum(stats)!r}D"
    split = node.split()
    test = f"{at}.{FEATURES[split.featureIndex()]} <= {split.threshold()!r}D"
    return f"CASE WHEN {test} THEN {_tree_sql(node.leftChild(), at)} ELSE {_tree_sql(node.rightChild(), at)} END"


def train(labelled: DataFrame, seed: int = 7) -> str | None:
    """SQL for the probability of a finding, with ``{f}`` for the struct of features.

    ``labelled`` has the features as column ``f`` and ``label``, 0 or 1. None without two kinds.
    """
    rows = labelled.where("label is not null").select("f.*", F.col("label").cast("double").alias("label")).distinct()
    drawn = rows.orderBy(F.xxhash64(*FEATURES, F.lit(seed)), *FEATURES, "label").limit(LABELLED_ROWS).coalesce(1)
    drawn = written(drawn, "findings")
    if drawn.select("label").distinct().count() < 2:
        return None
    ready = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(drawn)
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=seed, featureSubsetStrategy="sqrt").fit(ready)
    trees = [_tree_sql(tree._call_java("rootNode"), "{f}") for tree in forest.trees]
    return "(" + " + ".join(trees) + f") / {TREES}D"


def verdict(model: str | None, f: str) -> Column:
    """Whether the struct of features named ``f`` is a secret's."""
    if model is None:
        return F.coalesce(rule_label(F.expr(f)) == 1, F.lit(False))
    return F.expr(f"{model.replace('{f}', f)} >= {THRESHOLD}D")


def fit(docs: DataFrame, labelled: DataFrame | None = None) -> str | None:
    """The model for ``docs``, from labelled candidates or from rules on the table's own."""
    if labelled is None:
        own = docs.select(F.explode(candidates(F.col("text"))).alias("x")).select(features(F.col("x")).alias("f"))
        labelled = own.withColumn("label", rule_label(F.col("f")))
    else:
        labelled = labelled.select(features(F.struct("c", "b", "a")).alias("f"), "label")
    return train(labelled)


def find_secrets(docs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """(doc_id, n_candidates, n_secrets, spans) for every document; spans are start:end in
    characters, comma-joined."""
    scanned = written(docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"),
        candidates(F.col("text")).alias("found")), "candidates")
    each = scanned.select("row", F.posexplode("found").alias("at", "x")).select(
        "row", "at", F.length("x.c").alias("n"), F.col("x.skip").alias("skip"), features(F.col("x")).alias("f"))
    each = written(each, "features")
    model = fit(docs, labelled) if labelled is not None else train(each.withColumn("label", rule_label(F.col("f"))))
    upto = Window.partitionBy("row").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = each.withColumn("secret", verdict(model, "f")).withColumn(
        "until", F.sum(F.col("skip") + F.col("n")).over(upto))
    told = placed.where("secret").groupBy("row").agg(
        F.count("*").alias("n_secrets"),
        F.array_join(F.transform(
            F.sort_array(F.collect_list(F.struct((F.col("until") - F.col("n")).alias("start"), F.col("until")))),
            lambda s: F.concat_ws(":", s["start"], s["until"])), ",").alias("spans"))
    return scanned.select("row", "doc_id", F.size("found").cast("long").alias("n_candidates")).join(told, "row", "left").select(
        "doc_id", F.coalesce("n_candidates", F.lit(0)).alias("n_candidates"),
        F.coalesce("n_secrets", F.lit(0)).alias("n_secrets"), F.coalesce("spans", F.lit("")).alias("spans"))


def redact(docs: DataFrame, labelled: DataFrame | None = None, mask: str = MASK) -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by the mask and ``n_chars`` counted anew."""
    model = fit(docs, labelled)
    told = F.transform(F.transform("__found", lambda x: F.struct(x["c"].alias("c"), features(x).alias("f"))),
                       lambda y: F.struct(y["c"].alias("c"), y["f"].alias("f")))
    hidden = docs.withColumn("__found", candidates(F.col("text")))
    hidden = hidden.withColumn("__found", F.when(F.size("__found") > 0, told))
    secret = "false" if model is None else f"{model.replace('{f}', 'y.f')} >= {THRESHOLD}D"
    hidden = hidden.withColumn(
        "__found",
        F.transform("__found", lambda y: F.when(rule_label(y["f"]) == 1, F.lit(mask)).otherwise(y["c"]))
        if model is None else F.expr(f"transform(__found, y -> CASE WHEN {secret} THEN '{mask}' ELSE y.c END)"),
    )
    rebuilt = F.array_join(F.zip_with(
        F.split("text", CANDIDATE, -1), "__found", lambda g, c: F.concat(g, F.coalesce(c, F.lit("")))), "")
    hidden = hidden.withColumn("text", F.when(F.col("__found").isNotNull(), rebuilt).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        hidden = hidden.withColumn("n_chars", F.when(F.col("__found").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return hidden.drop("__found")


@query("op5_secret_forest")
def op5(spark, sf_dir):
    return find_secrets(table(spark, sf_dir, "documents"))
