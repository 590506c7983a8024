"""Operator 3 - URL filter: rules first, then logistic regression on hashed
character n-grams of host and path.

All of it is DataFrame expressions.  The classifier is trained from a small
labelled table of URLs by gradient descent in its dual form: one row holds the
table's Gram matrix, a fold over the rounds updates one coefficient for each
labelled URL, and the weights of the hashed n-grams are their sums.  Scoring
folds a URL's n-grams over the weights, which are a literal of fixed size
(``FEATURES``), so a page is judged where it is scanned: no join, no shuffle.

A URL's host is what follows the first ``://`` up to ``/``, ``?``, ``#`` or the
end, with A-Z lower-cased; its path follows up to ``?``, ``#`` or the end.  A
rule fits its own host and all subdomains if the path starts with the rule's;
the longest fitting rule decides (of equally long ones, ``allow``).

Very long URLs are scored whole, in time linear in their length.

Edge cases: a null URL or one without ``://`` has an empty host and path, fits
no rule, and has no n-gram but the markers, so the classifier judges it by its
bias.  Repeated rows each get a row, null ids too; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rules of the production query: verdict, host, path.
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]

#: Words that the site names of the small labelled table are made of.
BLOCKED_WORDS = [
    "casino", "poker", "slots", "roulette", "betting", "jackpot", "bonus", "pharmacy", "pills", "tablets", "loans", "credit", "payday", "adult", "cams", "dating",
    "warez", "crack", "replica", "prizes", "clicks", "banner", "tracker", "adserver", "spam", "backlinks", "miracle", "crypto", "discount", "lottery",
]
ALLOWED_WORDS = [
    "library", "museum", "school", "university", "news", "weather", "garden", "recipes", "history", "music", "science", "health", "travel", "books", "theatre", "city",
    "club", "research", "project", "railway", "orchestra", "botany", "society", "observatory", "language", "village", "river", "forest", "kitchen", "archive",
]


def sites(names: list[str]) -> list[str]:
    """Two site names for each word: with the next word but one by a hyphen, and joined with the one seven on."""
    n = len(names)
    return [name for i, word in enumerate(names) for name in (f"{word}-{names[(i + 2) % n]}", word + names[(i + 7) % n])]


def labelled_urls() -> list[tuple[str, int]]:
    """The small labelled table: two URLs of each site, 1 is to be blocked.

    Prefixes, endings and paths are dealt alike to both labels, so that only
    the names tell them apart.
    """
    prefixes, domains = ("", "www.", "m.", "blog."), ("com", "net", "org")
    paths = ("/en/{}", "/de/{}.html", "/fr/{}/", "/es/{}?page=2", "/en/{}#top")
    out = []
    for label, names in ((1, BLOCKED_WORDS), (0, ALLOWED_WORDS)):
        for i, site in enumerate(sites(names)):
            for k in range(2):
                path = paths[(i + k) % 5].format((17 * i + 331 * k) % 1000)
                out.append((f"https://{prefixes[(i + k) % 4]}{site}.example.{domains[(i + k) % 3]}{path}", label))
    return out


#: Hashed n-grams (three hexadecimal digits), their lengths, and the training's rounds, rate and ridge.
FEATURES = 1 << 12
NGRAMS = (3, 4)
ROUNDS = 60
RATE = 0.01
RIDGE = 0.001
#: Least probability of ``block``: a page blocked in error costs more than one let through.
THRESHOLD = 0.75

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL."""
    known = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    rest = F.regexp_extract(url, r"(?s)\A.*?://(.*)\z", 1)
    host = F.regexp_extract(rest, r"(?s)\A([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)\A[^/?#]*([^?#]*)", 1)
    return F.when(known, F.translate(host, _UPPER, _LOWER)).otherwise(""), F.when(known, path).otherwise("")


def _grams(mark: str, part: Column) -> Column:
    """Features of all n-grams of a part; a part shorter than n is one n-gram."""
    text = F.concat(F.lit("^"), part, F.lit("$"))
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    # each length joins the one before it with the characters that follow: linear in the length of the part
    joined, made = chars, []
    for n in range(2, max(NGRAMS) + 1):
        joined = F.zip_with(joined, F.slice(chars, n, F.greatest(F.char_length(text), F.lit(1))), lambda a, c: F.concat(a, c))
        if n in NGRAMS:
            known = F.filter(joined, lambda g: g.isNotNull())
            made.append(F.when(F.char_length(text) < n, F.array(text)).otherwise(known))
    return F.transform(F.concat(*made), lambda g: F.conv(F.substring(F.md5(F.concat(F.lit(mark), g)), 1, 3), 16, 10).cast("int"))


def features(host: Column, path: Column) -> Column:
    """Distinct hashed character n-grams of host and path, from 0: the first 12 bits of an MD5."""
    return F.array_distinct(F.concat(_grams("h", host), _grams("p", path)))


def _sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def train(spark: SparkSession, labelled: list[tuple[str, int]] | None = None) -> list[float]:
    """Weights of the hashed n-grams, and last the bias."""
    given = F.array(*[F.struct(F.lit(u).alias("url"), F.lit(y).alias("label")) for u, y in (labelled or labelled_urls())])
    urls = spark.range(1).select(F.inline(given))
    host, path = host_and_path(F.col("url"))
    rows = urls.select("url", F.col("label").cast("double").alias("y"), features(host, path).alias("x"))
    # bounded: the labelled table is one window and then one row
    everyone = F.sort_array(F.collect_list(F.struct("url", "y", "x")).over(Window.partitionBy(F.lit(0))))
    gram = F.transform("all", lambda b: (F.size(F.array_intersect(F.col("x"), b["x"])) + 1).cast("double"))
    rows = rows.withColumn("all", everyone).select("url", "y", "x", gram.alias("k"))
    table = rows.agg(F.sort_array(F.collect_list(F.struct("url", "y", "x", "k"))).alias("t"))
    step = lambda a: F.transform("t", lambda r, i: F.get(a, i) * (1 - RIDGE) + RATE * (r["y"] - _sigmoid(_dot(r["k"], a))))
    alpha = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), F.transform("t", lambda _: F.lit(0.0)), lambda a, _: step(a))
    solved = table.select("t", alpha.alias("a")).select(F.explode(F.arrays_zip("t", "a")).alias("r"))
    parts = solved.select(F.col("r.a").alias("a"), F.explode(F.concat("r.t.x", F.array(F.lit(FEATURES)))).alias("j"))
    weights = [0.0] * (FEATURES + 1)
    for row in parts.groupBy("j").agg(F.sum("a").alias("w")).collect():  # at most FEATURES + 1 rows
        weights[row["j"]] = row["w"]
    return weights


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """Rule string and verdict of the longest fitting rule, null without one."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, own, prefix in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[0] == "allow")):
        fits = ((host == own) | host.endswith(f".{own}")) & path.startswith(prefix)
        name, verdict = F.when(fits, own + prefix).otherwise(name), F.when(fits, what).otherwise(verdict)
    return name, verdict


def judge(pages: DataFrame, weights: list[float], carry: list[str], url: str = "url", rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """Columns ``carry`` with host, path, rule, verdict and the classifier's p_block."""
    host, path = host_and_path(F.col("u"))
    own = pages.select(F.col(url).alias("u"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(carry)])
    own = own.select(*[f"c{i}" for i in range(len(carry))], host.alias("host"), path.alias("path"))
    table = F.expr(f"array({', '.join(f'{w!r}D' for w in weights[:-1])})")
    score = F.aggregate(features(F.col("host"), F.col("path")), F.lit(weights[-1]), lambda s, j: s + F.get(table, j))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    own = own.withColumn("p_block", _sigmoid(score))
    judged = F.coalesce(verdict, F.when(F.col("p_block") >= THRESHOLD, "block").otherwise("allow"))
    return own.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(carry)], "host", "path", rule.alias("rule"), judged.alias("verdict"), "p_block")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's URL."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return judge(pages, train(spark), ["page_id"]).drop("p_block")


def _sql_parts(url: str) -> str:
    rest = f"regexp_extract({url}, '^(?s:.*?)://((?s:.*))$', 1)"
    host, path = f"regexp_extract({rest}, '^[^/?#]*')", f"regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1)"
    known = f"coalesce(contains({url}, '://'), false)"
    return f"CASE WHEN {known} THEN translate({host}, '{_UPPER}', '{_LOWER}') ELSE '' END AS host, CASE WHEN {known} THEN {path} ELSE '' END AS path"


def _sql_features() -> str:
    grams = []
    for mark, part in (("h", "host"), ("p", "path")):
        text = f"('^' || {part} || '$')"
        for n in NGRAMS:
            starts = f"range(1, greatest(length({text}) - {n - 1}, 1) + 1)"
            grams.append(f"list_transform({starts}, lambda i: CAST('0x' || substr(md5('{mark}' || substr({text}, i, {n})), 1, 3) AS INTEGER))")
    return f"list_distinct({' || '.join(grams)})"


def oracle_sql() -> str:
    """The query in DuckDB's SQL, its training included."""
    given = ", ".join(f"('{u}', {y})" for u, y in labelled_urls())
    rule, verdict = "NULL", "NULL"
    for what, own, prefix in sorted(RULES, key=lambda r: (len(r[1] + r[2]), r[0] == "allow")):
        fits = f"(host = '{own}' OR ends_with(host, '.{own}')) AND starts_with(path, '{prefix}')"
        rule, verdict = f"CASE WHEN {fits} THEN '{own}{prefix}' ELSE {rule} END", f"CASE WHEN {fits} THEN '{what}' ELSE {verdict} END"
    return f"""
WITH RECURSIVE given(url, y) AS (VALUES {given}),
learned AS (SELECT row_number() OVER (ORDER BY url) AS i, y, {_sql_features()} AS x FROM (SELECT url, y, {_sql_parts("url")} FROM given)),
gram AS (SELECT a.i, a.y, list(CAST(len(list_intersect(a.x, b.x)) + 1 AS DOUBLE) ORDER BY b.i) AS k FROM learned a, learned b GROUP BY a.i, a.y),
kept AS (SELECT list(struct_pack(y := y, k := k) ORDER BY i) AS t FROM gram),
solved AS (
    SELECT 0 AS r, list_transform(t, lambda x: CAST(0 AS DOUBLE)) AS a, t FROM kept
    UNION ALL SELECT r + 1, list_transform(t, lambda x, i: a[i] * (1 - CAST({RIDGE} AS DOUBLE)) + CAST({RATE} AS DOUBLE) * (x.y - 1 / (1 + exp(-list_dot_product(x.k, a))))), t FROM solved WHERE r < {ROUNDS}),
weights AS (SELECT j, sum(a[i]) AS w FROM (SELECT i, unnest(x) AS j FROM learned), (SELECT a FROM solved WHERE r = {ROUNDS}) GROUP BY j),
bias AS (SELECT list_sum(a) AS b FROM solved WHERE r = {ROUNDS}),
urls AS (SELECT row_number() OVER () AS id, page_id, {_sql_parts("url")} FROM pages),
scored AS (SELECT id, sum(w) AS s FROM (SELECT id, unnest({_sql_features()}) AS j FROM urls) JOIN weights USING (j) GROUP BY id)
SELECT page_id, host, path, {rule} AS rule,
    coalesce({verdict}, CASE WHEN 1 / (1 + exp(-(coalesce(s, 0) + b))) >= {THRESHOLD} THEN 'block' ELSE 'allow' END) AS verdict
FROM urls LEFT JOIN scored USING (id), bias
"""
