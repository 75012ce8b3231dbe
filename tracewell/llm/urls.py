"""URL filters: host and path rules, and logistic regression on hashed character n-grams for the rest.

The model is trained by Spark on a small labelled table of URLs, by default the
hosts below, each with every prefix and suffix of ``AROUND``, so that these
don't tell the classes apart (of hosts that are left out of training, half of
the bad and one in fifteen of the good ones are blocked); of a larger table the ``max_labelled`` distinct URLs
with the smallest hashes are used. Features are character 3-, 4- and 5-grams of host and path, hashed; everything
is built from DataFrame functions and Spark's own estimators.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import LOWER, UPPER, stored

#: Host, path and verdict of the rules.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
FEATURES = 1 << 14
#: Labelled hosts of the default table.
BLOCKED_HOSTS = (
    "casino-win casino-bonus online-casino best-casino casino-games poker-win bet-now sports-bet slots-free jackpot-win "
    "cheap-pills buy-pills pills-online cheap-meds viagra-shop diet-pills miracle-diet cheap-watches replica-bags fake-rolex "
    "spam-farm link-farm seo-links buy-links free-download free-money easy-money earn-cash cash-loans payday-loans "
    "ads-network ad-tracker track-pixel popup-ads click-here win-prize lottery-win adult-cams adult-zone xxx-videos hot-singles dating-xxx crack-keygen warez-free torrent-crack "
    "casino-royal mega-casino casino-vip poker-online poker-stars-bonus bet-live live-bets bet-bonus slots-online slot-machines-free roulette-win bingo-jackpot lotto-prize "
    "pharmacy-cheap cheap-viagra cialis-online pills-shop weight-loss-pills detox-miracle replica-watches fake-bags cheap-rolex rolex-replica "
    "seo-spam backlinks-cheap buy-followers buy-likes free-followers traffic-bot money-fast fast-cash quick-loans instant-loans crypto-doubler bitcoin-free "
    "adserver ads-click pixel-tracker popunder-ads free-prize claim-prize cams-live adult-chat xxx-tube singles-tonight serial-keys keygen-crack warez-downloads free-torrents"
).split()
ALLOWED_HOSTS = (
    "library university research science history museum archive journal physics medicine biology chemistry "
    "city-council parliament ministry national-park weather-service open-data news daily-news gazette radio "
    "school teachers cooking-blog travel-notes garden music-review book-club film-notes programming docs wiki "
    "charity community-center fire-department farm-market health-center bank-holidays games-history win-win-learning "
    "public-library national-archive art-museum city-museum history-society research-institute medical-journal physics-letters math-forum "
    "town-hall parliament-records tax-office statistics-office court-decisions consumer-advice food-safety water-board coast-guard "
    "morning-news local-gazette public-radio film-review theatre-notes poetry-archive language-school primary-school evening-classes teacher-training "
    "garden-club bird-watching hiking-trails bicycle-repair recipe-collection bread-baking knitting-patterns chess-club choir "
    "open-source-docs compiler-notes database-manual network-handbook astronomy geology botany zoology linguistics philosophy hospital nursing dentistry first-aid"
).split()
AROUND = (("", ".example.com/en/12"), ("www.", ".example.net/de/345.html"), ("m.", ".example.org/fr/6789/"), ("blog.", ".example.com/es/31"), ("", ".example.net"), ("www.", ".example.org/en/77"), ("", ".org/a"), ("m.", ".com/"))


def parts(df: DataFrame, url: str = "url") -> DataFrame:
    """``df`` with host (lower-cased) and path; both empty for null urls and those without ://. Columns of these names are replaced."""
    at = F.instr(F.col(url), "://")
    rest = F.when(at > 0, F.substring(F.col(url), at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return df.withColumn("host", F.coalesce(host, F.lit(""))).withColumn("path", F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit("")))


def decide(df: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    """``df`` (with host and path) with rule and decision of the longest rule that fits, or null."""
    rule, decision = F.lit(None).cast("string"), F.lit(None).cast("string")
    for host, path, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((F.col("host") == host) | F.endswith(F.col("host"), F.lit(f".{host}"))) & F.startswith(F.col("path"), F.lit(path))
        rule, decision = F.when(fits, f"{host}{path}").otherwise(rule), F.when(fits, verdict).otherwise(decision)
    return df.withColumn("rule", rule).withColumn("decision", decision)


def _grams(text: Column, tag: str) -> list[Column]:
    """Arrays of n-grams; digits count as one sign, so that page numbers don't tell pages apart."""
    framed = F.concat(F.lit("^"), F.regexp_replace(text, "[0-9]+", "0"), F.lit("$"))
    return [F.transform(F.sequence(F.lit(1), F.greatest(F.length(framed) - (n - 1), F.lit(1))), lambda i, n=n: F.concat(F.lit(tag), F.substring(framed, i, F.lit(n)))) for n in (3, 4, 5)]


def featured(df: DataFrame) -> DataFrame:
    df = df.withColumn("_grams", F.array_distinct(F.concat(*_grams(F.col("host"), "h"), *_grams(F.col("path"), "p"))))
    return HashingTF(numFeatures=FEATURES, binary=True, inputCol="_grams", outputCol="_features").transform(df)


def labelled_urls(hosts: Callable[[str], bool] = lambda host: True) -> list[tuple[str, int]]:
    """The default table (url, blocked), of the hosts that ``hosts`` takes."""
    return [(f"http://{before}{h}{after}", blocked) for blocked, names in ((1, BLOCKED_HOSTS), (0, ALLOWED_HOSTS)) for h in names if hosts(h) for before, after in AROUND]


def fit(pages: DataFrame, labelled: DataFrame | None = None, max_labelled: int = 5000) -> LogisticRegressionModel | None:
    """The model, or None where the labelled URLs are all of one kind or there are none.

    ``labelled`` (url, blocked 0 or 1) replaces the default table.
    """
    spark = pages.sparkSession
    if labelled is None:
        labelled = spark.createDataFrame(labelled_urls(), "url string, blocked int")
    labelled = parts(labelled).select("host", "path", F.col("blocked").cast("double").alias("label"))
    labelled = labelled.groupBy("host", "path").agg(F.max("label").alias("label"))
    rows = stored(featured(labelled.orderBy(F.xxhash64("host", "path"), "host", "path").limit(max_labelled)).select("_features", "label"), "url-labels")
    if rows.agg(F.count_distinct("label").alias("n")).first()["n"] < 2:
        return None
    return LogisticRegression(featuresCol="_features", labelCol="label", regParam=0.01, maxIter=50, probabilityCol="_probability", predictionCol="_prediction", rawPredictionCol="_raw").fit(rows)


def judge(pages: DataFrame, labelled: DataFrame | None = None, block_at: float = 0.75) -> DataFrame:
    """page_id, host, path, rule, verdict and the model's probability of each page.

    A rule's verdict holds, of those that fit the longest's; without one the
    model decides, and without a model the page is allowed. Null urls and those
    without a host are judged by the model as empty ones. Repeated rows are
    judged alike, an empty table gives no rows; only page_id and url are read.
    """
    model = fit(pages, labelled)
    df = decide(parts(pages.select("page_id", "url")))
    if model is None:
        df = df.withColumn("blocked", F.lit(0.0))
    else:
        df = model.transform(featured(df)).withColumn("blocked", vector_to_array("_probability")[1])
    verdict = F.coalesce(F.col("decision"), F.when(F.col("blocked") >= block_at, "block").otherwise("allow"))
    return df.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.round("blocked", 6).alias("blocked"))
