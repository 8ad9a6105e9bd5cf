"""URL filter: rules for hosts and paths, then logistic regression on hashed character n-grams of host and path.

The model is fitted with Spark ML on a small labelled table of urls: at most ``max_labelled`` rows (20,000 by default),
the first by a hash of the url, which bounds the fit; every url of the table to judge is judged. All columns are built-in functions,
and the work on a url grows with its length: it is cut into characters once.

Up to ``UNROLLED`` rules are one expression. More are a table that is joined with the hosts' suffixes: once for each distinct
host, so that a host that most urls have does not matter, and then by host; hosts that hold many rows are broadcast, a bounded number.

Defined results: a null url, or one without ``://``, has an empty host and path and gets the model's verdict for
them; repeated urls and ids are judged row by row; of equal rules the last counts; rules as long as each other can't both fit, as
they are then one; an empty table gives no rows; columns of the input besides the id and the url are not looked at.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .skew import join_hot
from .text import ascii_lower

#: Words of the made-up labelled table: hosts and paths worth keeping, and those that are not.
KEEP_HOSTS = (
    "library science history journal museum college research garden archive weather university institute biology physics gallery "
    "orchestra newspaper chronicle observatory academy school teacher farming medicine hospital astronomy geology language literature heritage"
).split()
KEEP_PATHS = "article guide lesson manual news essay recipe tutorial paper review chapter lecture report interview biography study atlas glossary opinion column".split()
DROP_HOSTS = (
    "casino poker pills clicks adserver betting torrent dating coupons tracker jackpot slots viagra escort payday lottery "
    "warez cracks keygen freeloans cheapmeds adclick popads bettips spincasino pokerbonus hotdating freetorrent couponclicks trackads"
).split()
DROP_PATHS = "login cart popup jackpot bonus redirect checkout signup banner download.exe click affiliate promo freespins register tracking adframe logout payout refer".split()
ENDINGS = ("com", "org", "net", "example.com", "info")
UNROLLED = 50


def labelled_urls(spark: SparkSession) -> DataFrame:
    """(url, label, host_word, path_word): invented urls, label 1 for those to block, made by rule from the word lists above."""
    words = lambda x: F.array(*map(F.lit, x))
    kinds = F.array(*(F.struct(words(h).alias("hosts"), words(p).alias("paths"), F.lit(y).alias("label")) for h, p, y in ((KEEP_HOSTS, KEEP_PATHS, 0.0), (DROP_HOSTS, DROP_PATHS, 1.0))))
    rows = spark.range(1).select(F.explode(kinds).alias("k")).select("k.label", F.explode("k.hosts").alias("h"), "k.paths")
    rows = rows.select("label", "h", F.posexplode("paths").alias("i", "p")).withColumn("j", F.pmod(F.xxhash64("h", "p"), F.lit(len(ENDINGS))).cast("int"))
    front = F.when(F.pmod(F.xxhash64("p", "h"), F.lit(3)) == 0, "").otherwise("www.")
    host = F.concat(front, "h", F.when(F.col("i") % 2 == 0, (F.col("i") * 7 + F.col("j")).cast("string")).otherwise(""), F.lit("."), F.get(words(ENDINGS), F.col("j")))
    return rows.select(F.concat(F.lit("https://"), host, F.lit("/"), "p", F.lit("/"), (F.col("i") * 31 + F.col("j")).cast("string")).alias("url"), "label", F.col("h").alias("host_word"), F.col("p").alias("path_word"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host after the first ``://``, in lower case, and the path up to ``?`` or ``#``; both empty where there is none."""
    u = F.coalesce(url, F.lit(""))
    return ascii_lower(F.regexp_extract(u, "://([^/?#]*)", 1)), F.regexp_extract(u, "://[^/?#]*([^?#]*)", 1)


def _grams(chars: Column, mark: str, sizes: Sequence[int]) -> Column:
    """The n-grams of an array of characters, or all of it where it is shorter."""
    gram = lambda n: F.transform(F.sequence(F.lit(0), F.greatest(F.size(chars) - n, F.lit(0))), lambda i: F.concat(F.lit(mark), *(F.coalesce(F.get(chars, i + k), F.lit("")) for k in range(n))))
    return F.concat(*map(gram, sizes))


def _features(df: DataFrame, bits: int, sizes: Sequence[int]) -> DataFrame:
    cut = lambda c: F.regexp_extract_all(F.concat(F.lit("^"), F.col(c), F.lit("$")), F.lit("(?s)."), F.lit(0))
    df = df.withColumns({"_host_chars": cut("host"), "_path_chars": cut("path")})
    grams = F.concat(_grams(F.col("_host_chars"), "h", sizes), _grams(F.col("_path_chars"), "p", sizes))
    return HashingTF(numFeatures=1 << bits, binary=True, inputCol="_grams", outputCol="_features").transform(df.withColumn("_grams", grams))


def fit(labelled: DataFrame, bits: int = 14, sizes: Sequence[int] = (3, 4), max_labelled: int = 20_000) -> LogisticRegressionModel:
    """The model from a table (url, label 0 or 1); rows with a null in either do not count."""
    host, path = host_and_path(F.col("url"))
    rows = labelled.select("url", F.col("label").cast("double").alias("label")).dropna().orderBy(F.xxhash64("url"), "url", "label").limit(max_labelled)
    rows = _features(rows.select("label", host.alias("host"), path.alias("path")).coalesce(1), bits, sizes)
    return LogisticRegression(featuresCol="_features", maxIter=40, regParam=0.01).fit(rows.select("label", "_features"))


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest rule (``host/path``) that fits a url: of its host or a domain above it, with a path that starts so."""
    fits = []
    for rule in sorted({r for _, r in rules}, key=lambda r: (-len(r), r)):
        h, slash, p = rule.partition("/")
        fits.append(F.when(((host == h) | host.endswith("." + h)) & path.startswith(slash + p), F.lit(rule)))
    return F.coalesce(*fits, F.lit(None).cast("string")) if fits else F.lit(None).cast("string")


def with_rules(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """``rows(host, path)`` with ``rule`` and ``by_rule``, from a table ``rules(verdict, rule)`` of any size; rules of one host are one row's array."""
    domain = F.split("rule", "/", 2)[0]
    known = rules.select("rule", "verdict", domain.alias("domain"), F.substr("rule", F.length(domain) + 1).alias("start"))
    hosts = rows.groupBy("host").agg(F.count("*").alias("n"))
    parts = F.split("host", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    fits = hosts.select("host", F.explode(above).alias("domain")).join(known, "domain")
    fits = fits.groupBy("host").agg(F.array_sort(F.collect_list(F.struct((-F.length("rule")).alias("n"), "rule", "start", "verdict"))).alias("fits"))
    met = join_hot(rows, hosts.join(fits, "host", "left"), "host", "n")
    met = met.withColumn("fit", F.get(F.filter("fits", lambda f: F.col("path").startswith(f["start"])), F.lit(0)))
    return met.select(*rows.columns, F.col("fit.rule").alias("rule"), F.col("fit.verdict").alias("by_rule"))


def judge(pages: DataFrame, model: LogisticRegressionModel, rules: Sequence[tuple[str, str]], id_col: str = "page_id", url_col: str = "url", bits: int = 14, sizes: Sequence[int] = (3, 4), unrolled: int = UNROLLED) -> DataFrame:
    """(id, host, path, rule, verdict, p_block): the rule's verdict where one fits, else the model's."""
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    verdicts = {r: v for v, r in rules}
    if len(verdicts) <= unrolled:
        rows = rows.withColumn("rule", rule_for(F.col("host"), F.col("path"), rules))
        by_rule = F.coalesce(*(F.when(F.col("rule") == r, F.lit(v)) for r, v in verdicts.items())) if verdicts else F.lit(None).cast("string")
        rows = rows.withColumn("by_rule", by_rule)
    else:
        known = pages.sparkSession.createDataFrame([(v, r) for r, v in verdicts.items()], "verdict string, rule string")
        rows = with_rules(rows, known)
    rows = model.transform(_features(rows, bits, sizes))
    by_model = F.when(F.col("prediction") == 1.0, "block").otherwise("allow")
    p_block = F.element_at(vector_to_array(F.col("probability")), 2)
    return rows.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("by_rule", by_model).alias("verdict"), F.round(p_block, 6).alias("p_block"))
