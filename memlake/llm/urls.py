"""URL filters: fixed host and path rules, and gradient-boosted trees on lexical features for the rest.

Everything here is DataFrame functions and MLlib; no Python runs in tasks.
"""

from __future__ import annotations

import random
from collections.abc import Sequence

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: (verdict, host/path) of the rules; a rule fits its host, all subdomains and the paths that start with its own.
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)
#: Trees, their depth, and labelled URLs that they are fitted on at most.
TREES, DEPTH, SAMPLE = 12, 3, 20_000

# Words of commercial, gambling, adult and tracking hosts.
WORDS = (
    "ads adult bet bets bonus buy casino cheap click coupon dating deal deals discount farm free jackpot loan loans lottery "
    "meds pharma pills poker porn prize promo replica sale sex slots spam sweepstakes track tracker traffic viagra win x xxx"
).split()
# Those of WORDS that ordinary hosts have too.
MILD = frozenset("bonus buy cheap click deal deals farm free promo prize sale track traffic win x".split())
# Parts of ordinary host names, for the labelled table.
PLAIN = (
    "archive atlas botany campus chronicle city climate clinic college council courier daily forum garden gazette geology "
    "harbor herald history journal kitchen lab library meteo mountain museum music observer opera orchard press railway "
    "review river school science society studio survey theater times tribune university valley village weekly winery"
).split()
_PATHS = ("/", "/en/{n}", "/fr/{n}/", "/de/{n}.html", "/es/{n}?page=2&ref=x", "/en/{n}?utm_source=feed", "/a/b/{n}#top")
_LONG = ("/2024/05/{n}/{a}-{b}-{c}", "/{a}/{b}/{c}/{n}.html", "/{a}?q={b}%20{c}&lang=en&page={n}", "/{a}/{b}?id={n}&ref={c}&utm_source=feed")
_ENDINGS = ("com", "net", "org", "info", "top")


def _spam_host(draw: random.Random) -> str:
    plain, listed, kind = draw.choice(PLAIN), draw.choice(WORDS), draw.random()
    join = draw.choice(("-", "-", "."))
    if kind < 0.3:
        return f"{listed}-{draw.choice(WORDS)}"
    if kind < 0.5:
        other = draw.choice((plain, _invented(draw)))
        strong = draw.choice([word for word in WORDS if word not in MILD])
        return join.join(draw.sample((strong, other), 2))
    if kind < 0.6:
        return f"{listed}{join}{plain}{draw.randint(10, 9999)}"
    if kind < 0.85:
        letters = "abcdefghijklmnopqrstuvwxyz" + "0123456789" * draw.randint(0, 1)
        return "".join(draw.choices(letters, k=draw.randint(12, 24)))
    return "-".join(draw.choices(PLAIN, k=draw.randint(1, 4)))


def _invented(draw: random.Random) -> str:
    return "".join(draw.choice(("th", "er", "on", "ti", "an", "re", "le", "ou", "sh", "in")) for _ in range(draw.randint(2, 5)))


def _plain_host(draw: random.Random) -> str:
    plain, other, kind = draw.choice(PLAIN), draw.choice(PLAIN), draw.random()
    if kind < 0.35:
        return plain
    if kind < 0.65:
        return draw.choice((f"{plain}-{other}", plain + other, f"{plain}.{other}"))
    if kind < 0.78:
        return _invented(draw)
    if kind < 0.9:
        return draw.choice(("-", ".")).join(draw.sample((draw.choice(sorted(MILD)), plain), 2))
    if kind < 0.93:
        return f"{plain}-{draw.choice(WORDS)}"
    if kind < 0.94:
        return "-".join(draw.sample(sorted(MILD), 2))
    return f"{plain}{draw.randint(1, 9999)}"


def labelled_urls(spark: SparkSession, n: int = 1200, seed: int = 7) -> DataFrame:
    """`n` rows of url and label (1: block), half of each, made by rule, so that no feature alone tells them apart.

    Blocked hosts have two words of WORDS, one, or none (random letters and digits, plain words); those of plain words
    and one in four of the others have many parameters with escapes. Allowed hosts are plain words, some with digits or
    a word of MILD, a few with any word of WORDS or with two; one in eight has a long address. Both have all endings.
    """
    draw, values = random.Random(seed), []
    for i in range(n):
        label = i % 2
        host = _spam_host(draw) if label else _plain_host(draw)
        a, b, c = draw.choices(PLAIN, k=3)
        path = draw.choice(_LONG if draw.random() < (0.33 if label else 0.12) else _PATHS)
        path = path.format(n=draw.randint(0, 99_999), a=a, b=b, c=c)
        plain = all(word in PLAIN for word in host.split("-"))
        if label and (plain or draw.random() < 0.25) or draw.random() < 0.01:
            more = "&".join(f"{k}={draw.randint(0, 1 << 40)}%2F" for k in ("aff", "cid", "sub", "clk")[: draw.randint(2, 4)])
            path += ("&" if "?" in path else "?") + more
        ending = draw.choices(_ENDINGS, (4, 4, 4, 2, 2) if label else (5, 4, 5, 1, 1))[0]
        prefix = draw.choice(("", "www.", "blog.", "m."))
        values.append(f"('http{'s' * draw.randint(0, 1)}://{prefix}{host}.example.{ending}{path}', {label})")
    return spark.sql(f"SELECT * FROM VALUES {', '.join(values)} AS labelled(url, label)")


def _lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(df: DataFrame, url: str = "url") -> DataFrame:
    """`df` with host (A-Z lower-cased) and path; both empty for null and for a URL without `://`."""
    at = F.instr(F.col(url), "://")
    rest = F.when(at > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")).otherwise("")
    return df.withColumns(
        {
            "host": F.coalesce(_lower(F.regexp_extract(rest, "^([^/?#]*)", 1)), F.lit("")),
            "path": F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit("")),
        }
    )


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for outcome, written in sorted(rules, key=lambda r: len(r[1])):
        domain, slash, rest = written.partition("/")
        fits = ((host == domain) | host.endswith(f".{domain}")) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, written).otherwise(rule), F.when(fits, outcome).otherwise(verdict)
    return rule, verdict


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def features(df: DataFrame, url: str = "url") -> DataFrame:
    """`df`, which has host and path, with lexical features of the URL; all zero where there is no host."""
    address, host, path = F.coalesce(F.col(url), F.lit("")), F.col("host"), F.col("path")
    n = F.greatest(F.length(host), F.lit(1))
    name = F.regexp_replace(host, r"^(?:www|blog|m)\.", "")
    words = F.split(name, "[^a-z0-9]+")

    def part(total: Column, char: Column) -> Column:
        p = (n - F.length(F.replace(host, char, F.lit("")))) / n
        return total - F.when(p > 0, p * F.log2(p)).otherwise(0.0)

    made = {
        "f_length": F.length(address),
        "f_host_length": F.length(host),
        "f_depth": _count(path, "/[^/]+"),
        "f_digit_ratio": _count(address, "[0-9]") / F.greatest(F.length(address), F.lit(1)),
        "f_host_digits": _count(host, "[0-9]"),
        "f_entropy": F.aggregate(F.array_distinct(F.split(host, "")), F.lit(0.0), part),
        "f_params": _count(address, r"[?&][^=&#]*="),
        "f_labels": _count(host, r"[^.]+"),
        "f_hyphens": _count(host, "-"),
        "f_words": F.size(F.array_intersect(words, F.array(*map(F.lit, WORDS)))),
        "f_mild": F.size(F.array_intersect(words, F.array(*map(F.lit, sorted(MILD))))),
        "f_escapes": _count(address, "%[0-9A-Fa-f]{2}"),
    }
    return df.withColumns({key: value.cast("double") for key, value in made.items()})


FEATURES = (
    "f_length f_host_length f_depth f_digit_ratio f_host_digits f_entropy f_params f_labels f_hyphens f_words f_mild f_escapes f_suffix"
).split()


class UrlModel:
    """Boosted trees on the lexical features and on the share of blocked labelled URLs by host ending."""

    def __init__(self, trees: GBTClassificationModel, suffixes: dict[str, float]):
        self.trees, self.suffixes = trees, suffixes

    def importances(self) -> dict[str, float]:
        """How much each of FEATURES decides, all together 1."""
        return dict(zip(FEATURES, map(float, self.trees.featureImportances.toArray())))

    def assembled(self, df: DataFrame, url: str = "url") -> DataFrame:
        return _assemble(features(df, url), self.suffixes)


def _assemble(df: DataFrame, suffixes: dict[str, float]) -> DataFrame:
    ending = F.regexp_extract("host", r"([^.]*)$", 1)
    rates = F.create_map(*[F.lit(x) for pair in suffixes.items() for x in pair])
    rated = df.withColumn("f_suffix", F.coalesce(F.try_element_at(rates, ending), F.lit(0.5)))
    return VectorAssembler(inputCols=FEATURES, outputCol="f_vector", handleInvalid="keep").transform(rated)


def train(labelled: DataFrame, sample: int = SAMPLE) -> UrlModel:
    """Fit on labelled URLs (url, label 0 or 1), `sample` at most, the same ones each time."""
    rows = split_url(labelled.where("url is not null and label is not null").orderBy(F.xxhash64("url"), "url").limit(sample))
    ending = F.regexp_extract("host", r"([^.]*)$", 1).alias("ending")
    common = rows.groupBy(ending).agg(F.count("*").alias("n"), F.sum("label").alias("blocked"))
    top = common.orderBy(F.desc("n"), "ending").limit(1000).collect()
    suffixes = {row.ending: (row.blocked + 5.0) / (row.n + 10.0) for row in top} or {"": 0.5}
    data = _assemble(features(rows), suffixes).select("f_vector", F.col("label").cast("double").alias("label"))
    trees = GBTClassifier(featuresCol="f_vector", labelCol="label", maxIter=TREES, maxDepth=DEPTH, maxBins=32, seed=7)
    return UrlModel(trees.fit(data.coalesce(1)), suffixes)


def judge(df: DataFrame, model: UrlModel, url: str = "url", keep: Sequence[str] = (), rules=RULES) -> DataFrame:
    """The columns `keep` of `df`, host, path, rule and verdict, row by row.

    The verdict is the longest fitting rule's; without rule the trees', and `allow` where there is no host.
    """
    kept = [name for name in keep if name not in ("host", "path", "rule", "verdict")]
    rows = df.select(*kept, F.col(url).alias("f_url"))
    judged = model.trees.transform(model.assembled(split_url(rows, "f_url"), "f_url"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    block = (F.col("prediction") == 1) & (F.col("host") != "")
    return judged.select(
        *kept, "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(block, "block").otherwise("allow")).alias("verdict")
    )
