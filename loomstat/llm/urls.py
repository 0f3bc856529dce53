"""URL filters: rules first, and logistic regression where no rule fits.

Pages are judged by SQL expressions. The features of a URL are the distinct hashed character
n-grams of its host and of its path, in a half of the buckets each. The model is fitted on a small
labelled table of bounded size: its features are gathered, and the driver finds the weights by
gradient descent. The weights, a fixed number, become a literal.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstat.llm._common import ascii_lower, table

BUCKETS = 8192
EPOCHS = 300
RATE = 20.0
MOMENTUM = 0.95
RIDGE = 3e-5
#: Rows that a model is fitted on, at most: those with the smallest hashes of their urls.
FIT_ROWS = 20_000
#: (allow or block, host/path prefix)
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))

#: The labelled table: hosts with a word of _BAD are to be blocked, others not. All else, the words beside
#: it and the paths, is drawn alike for both, so that only the host's words tell; paths with a part of
#: _BAD_PATHS are to be blocked under any host.
_BAD = (
    "ads adserver adclick adtrack tracker tracking spam spammer casino poker betting bets gambling jackpot lottery slots pills pharma viagra adult xxx porn escort phishing malware virus trojan "
    "scam fraud loans payday warez torrent popup popunder clickbait doorway linkfarm spyware hacked keygen"
).split()
_GOOD = (
    "garden city museum weather library river school recipes travel science music history northern thistle other together thunder heather nation station notion motion think healthy brother gather "
    "therapy another earth ontario honest onion stone anthem panther thread entire ireland eastern western tire street treat wheat adelaide madrid spain radio shadow academy broadway leads roads "
    "breads winter window windmill farmhouse tractor betsy beta alphabet diabetes pillow pillar advent adventure address admin adapter casing castle popular popcorn bannerman slovenia scandinavia "
    "pharaoh loan-library portland export pocket polka torment tornado spanish sparta warehouse virginia track-field cliff clinic doorbell hacker-news keyboard github wikipedia python weekly"
).split()
_BESIDE = "win farm track click free cheap bonus online deals x hub zone now best host net store shop world daily live club plus info".split()
#: Common letter groups of English, of which invented ordinary names are made.
_GROUPS = "th he in er an re on at en nd ti es or te of ed is it al ar st nt to ing ion tion ther ent ble wh ou sh ha as".split()
_BAD_PATHS = "adserver popunder clicktrack spamlink freepills".split()
_SUBDOMAINS = ("", "", "www.", "m.", "blog.", "shop.", "news.", "cdn.")
_DOMAINS = (".example.com", ".example.net", ".example.org", ".com", ".net", ".org", ".info")


def _pick(options, *salt) -> str:
    words = "array(" + ", ".join(f"'{x}'" for x in options) + ")"
    return f"element_at({words}, CAST(1 + pmod(xxhash64(id, {', '.join(map(str, salt))}), {len(options)}) AS INT))"


def _table(spark: SparkSession) -> DataFrame:
    """``url, label, held``: about 6,000 rows by rule; hosts of the held-out part are not in the other."""
    number = "pmod(xxhash64(id, 30), 10000)"
    made = (
        spark.range(6000).selectExpr("id", "pmod(id, 8) < 3 AS bad", f"{_pick(_BESIDE, 1)} AS b", f"concat({_pick(_GROUPS, 2)}, {_pick(_GROUPS, 3)}, {_pick(_GROUPS, 4)}) AS name", f"{_pick(_GOOD, 5)} AS g", f"{_pick(_BAD, 6)} AS v")
        .selectExpr("*", "CASE WHEN bad THEN v WHEN pmod(xxhash64(id, 7), 2) = 0 THEN g ELSE name END AS a")
        .selectExpr("*", "CASE pmod(xxhash64(id, 8), 5) WHEN 0 THEN a WHEN 1 THEN concat(a, '-', b) WHEN 2 THEN concat(b, '-', a) WHEN 3 THEN concat(a, '.', name) ELSE concat(a, '-', name) END AS site")
        .selectExpr("*", f"concat({_pick(_SUBDOMAINS, 9)}, site, {_pick(_DOMAINS, 10)}) AS host", f"{_pick([*_GOOD, *_BAD, *_BESIDE], 11)} AS w", f"{number} AS n", f"{_pick(('en', 'de', 'fr', 'es'), 12)} AS lang")
        .selectExpr(
            "*", "CASE pmod(xxhash64(id, 13), 9) WHEN 0 THEN concat('/', lang, '/', n) WHEN 1 THEN concat('/', lang, '/', n, '.html') WHEN 2 THEN concat('/wiki/', initcap(w)) WHEN 3 THEN concat('/user/', w)"
            " WHEN 4 THEN concat('/', w) WHEN 5 THEN concat('/2023/05/', w, '-', g) WHEN 6 THEN concat('/', lang, '/', n, '/') WHEN 7 THEN '/' ELSE '' END AS path", "NOT bad AND pmod(xxhash64(id, 14), 12) = 0 AS led",
        )
    )
    return made.selectExpr(
        f"concat(IF(n % 2 = 0, 'http://', 'https://'), host, IF(led, concat('/', {_pick(_BAD_PATHS, 15)}, '/', w, n), path)) AS url", "CAST(bad OR led AS INT) AS label", "pmod(xxhash64(site), 5) = 0 AS held"
    )


def labelled(spark: SparkSession) -> DataFrame:
    """``url, label`` (1: block) to learn from."""
    return _table(spark).where("NOT held").select("url", "label")


def held_out(spark: SparkSession) -> DataFrame:
    """``url, label`` of hosts that ``labelled`` does not have."""
    return _table(spark).where("held").select("url", "label")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null and without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return ascii_lower(host), path


def _grams(text: str, first: int) -> str:
    """SQL for the distinct hashed 3- to 5-grams of a marked text, as buckets from ``first`` on."""
    gram = lambda n: f"transform(IF(size(c) >= {n}, sequence(1, size(c) - {n - 1}), CAST(array() AS array<int>)), i -> CAST({first} + pmod(xxhash64({', '.join(f'element_at(c, i + {k})' for k in range(n))}), {BUCKETS // 2}) AS INT))"
    return f"transform(array(split(concat('^^', {text}, '$'), '')), c -> array_distinct(concat({', '.join(map(gram, (3, 4, 5)))})))[0]"


def features(host: str = "host", path: str = "path") -> Column:
    """Struct of ``h`` and ``p``: the buckets of the host and of the path column, never empty."""
    return F.expr(f"named_struct('h', {_grams(host, 0)}, 'p', {_grams(path, BUCKETS // 2)})")


def fit(rows: DataFrame) -> list[float]:
    """Bias and weights from a table ``url, label`` of 0 and 1, of which at most FIT_ROWS count. Null labels
    are left out; without rows all are zero. Repeated rows count each."""
    host, path = host_and_path(F.col("url"))
    few = rows.where("label IS NOT NULL").select("url", F.col("label").cast("double").alias("y")).orderBy(F.xxhash64("url"), "url", "y").limit(FIT_ROWS)
    made = few.select(host.alias("host"), path.alias("path"), "y", "url").select(features().alias("f"), "y").collect()  # FIT_ROWS rows at most
    w = np.zeros(BUCKETS + 1)
    if not made:
        return w.tolist()
    sides = [side for r in made for side in (r["f"]["h"], r["f"]["p"])]
    sizes = np.array([len(x) for x in sides])
    at = np.concatenate([np.asarray(x) for x in sides]) + 1
    row = np.repeat(np.arange(len(sides)) // 2, sizes)
    value = np.repeat(1 / np.sqrt(sizes), sizes)
    y = np.array([r["y"] for r in made])
    step = np.zeros_like(w)
    for _ in range(EPOCHS):
        margin = w[0] + np.bincount(row, weights=w[at] * value, minlength=len(y))
        wrong = 1 / (1 + np.exp(-np.clip(margin, -40, 40))) - y
        slope = np.bincount(at, weights=wrong[row] * value, minlength=len(w)) / len(y) + RIDGE * w
        slope[0] = wrong.mean()
        step = MOMENTUM * step - RATE * slope
        w += step
    return w.tolist()


def judge(pages: DataFrame, weights: list[float], rules=RULES, url_col: str = "url", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """``keep`` columns with ``host, path, rule, verdict, score`` of every row.

    The longest rule that fits decides, of equally long ones the first in alphabetical order;
    without one, the verdict is block where the model's probability is above one half. Null and
    empty urls, and those without ``://``, have an empty host and path and are judged by the model.
    Repeated rows are judged each, an empty table gives an empty result.
    """
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(*keep, host.alias("host"), path.alias("path"))
    rule = F.lit(None).cast("string")
    verdict = F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: (len(r[1]), [-ord(c) for c in r[1]])):
        of, _, start = text.partition("/")
        fits = ((F.col("host") == of) | F.col("host").endswith("." + of)) & F.col("path").startswith("/" + start)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    literal = "array(" + ", ".join(f"{w:.6g}D" for w in weights[1:]) + ")"
    side = lambda x: f"aggregate({x}, 0.0D, (s, b) -> s + element_at({literal}, b + 1)) / sqrt(size({x}))"
    margin = F.expr(f"{weights[0]!r}D + {side('f.h')} + {side('f.p')}")
    scored = rows.withColumn("f", features()).withColumn("score", 1 / (1 + F.exp(-margin)))
    return scored.select(*keep, "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("score") > 0.5, "block").otherwise("allow")).alias("verdict"), "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: judge the url of every page."""
    return judge(table(spark, sf_dir, "pages"), fit(labelled(spark))).drop("score")
