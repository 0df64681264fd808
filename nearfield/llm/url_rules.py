"""Verdicts on urls by rules, each of them indexed by its rarest literal token.

A rule is either a host and the start of a path, ``example.com/en/``, which fits the host and its subdomains, or a pattern of literal
text with ``*`` for any characters and ``^`` for the start, the end or one character that is no letter or digit. Both become regular
expressions. A literal token is a whole run of letters and digits that every url which fits must have; of a rule's tokens the one that the fewest
urls have is its key in the index. The tokens of a url fetch the rules under them, and only those are run on it. Rules without
such a token stand under the empty one, which every url has.

All steps are DataFrame operations: tokens are counted over all urls, the index is joined with the exploded tokens of the
urls (Spark broadcasts it while it is small, and splits hot tokens otherwise), and the matches of a url are reduced to one before they are joined back.

Defined results: a null url, or one without ``://``, has an empty host and path, no rule and the verdict ``allow``; a host is lower-cased in
A-Z only; rules of hosts come before patterns, longer ones first, then ``block`` before ``allow``, then the greater text. A rule of a host with
``?`` or ``#`` fits nothing. Rows that repeat, and null ids, are each answered; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize

# fixed values
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
PATTERNS = (
    ("block", "^casino^"), ("block", "^bets^"), ("block", "^poker^"), ("block", "^spam^"), ("block", "^pills^"), ("block", "^adult^"),
    ("block", "^ads-track^"), ("block", "^porn^"), ("block", "^click*.php^"), ("allow", "^adult-education^"), ("allow", "^anti-spam^"),
)
DEFAULT = "allow"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)\A.*?://([^/?#]*)([^?#]*)(.*)\z"
TOKEN = "[a-z0-9]+"
#: A run in the text of a rule that is whole in every url it fits: it has an edge on both sides, and no wildcard.
WHOLE_TOKEN = "(?<=[^a-z0-9*])[a-z0-9]+(?=[^a-z0-9*])"
EDGE = r"(?:\A|[^a-z0-9]|\z)"
PUNCTUATION = r"([\x21-\x29\x2B-\x2F\x3A-\x40\x5B-\x5D\x5F\x60\x7B-\x7E])"


def lowered(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def url_parts(url: Column) -> tuple[Column, Column, Column]:
    """Host, path, and what follows it; all empty if there is no ``://``."""
    part = lambda k: F.coalesce(F.regexp_extract(url, PARTS, k), F.lit(""))
    return lowered(part(1)), part(2), part(3)


def _listed(spark: SparkSession, rows, kind: str) -> DataFrame:
    texts = F.array(*[F.struct(F.lit(v).alias("verdict"), F.lit(t).alias("rule")) for v, t in rows])
    return spark.range(1).select(F.inline(texts)).withColumn("kind", F.lit(kind))


def default_rules(spark: SparkSession) -> DataFrame:
    return _listed(spark, RULES, "host").unionByName(_listed(spark, PATTERNS, "pattern"))


def compiled(rules: DataFrame) -> DataFrame:
    """verdict, rule, kind, rank, regex and tokens of rules (verdict, rule, kind ``host`` or ``pattern``)."""
    host = F.col("kind") == "host"
    slash = F.instr("rule", "/")
    name = lowered(F.when(slash > 0, F.expr("substring(rule, 1, instr(rule, '/') - 1)")).otherwise(F.col("rule")))
    path = F.when(slash > 0, F.expr("substring(rule, instr(rule, '/'))")).otherwise(F.lit(""))
    quoted = F.regexp_replace(F.concat(name, path), PUNCTUATION, r"\\$1")
    quoted = F.replace(F.replace(quoted, F.lit("*"), F.lit(r"\*")), F.lit("^"), F.lit(r"\^"))
    of_host = F.concat(F.lit(r"(?s)\A(?:[^/]*\.)?"), quoted, F.when(path == "", F.lit(r"(?=/|\z)")).otherwise(F.lit("")))
    literal = F.regexp_replace(lowered(F.col("rule")), PUNCTUATION, r"\\$1")
    of_pattern = F.concat(F.lit("(?s)"), F.replace(F.replace(literal, F.lit("*"), F.lit(".*")), F.lit("^"), F.lit(EDGE)))
    edged = F.when(host, F.concat(F.lit("^"), lowered(F.replace("rule", F.lit("*"), F.lit("/"))), F.when(path == "", F.lit("^")).otherwise(F.lit("")))).otherwise(lowered(F.col("rule")))
    return rules.where(~host | ~F.col("rule").rlike("[?#]")).select(
        "verdict", "rule", "kind",
        F.struct(host.alias("host"), F.length("rule").alias("length"), F.col("verdict").alias("verdict"), F.col("rule").alias("rule")).alias("rank"),
        F.when(host, of_host).otherwise(of_pattern).alias("regex"),
        F.array_distinct(F.regexp_extract_all(edged, F.lit(f"({WHOLE_TOKEN})"))).alias("tokens"),
    )


def url_tokens(low: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(low, F.lit(f"({TOKEN})")))


def rule_index(rules: DataFrame, urls: DataFrame) -> DataFrame:
    """kind, rank, regex and the token under which each rule stands: its rarest over all rows of urls (low)."""
    rules = compiled(rules)
    own = rules.select("rule", "kind", "verdict", F.explode("tokens").alias("token"))
    counts = urls.select(F.explode(url_tokens(F.col("low"))).alias("token")).join(own.select("token").distinct(), "token", "left_semi").groupBy("token").agg(F.count("*").alias("n"))
    rarest = own.join(counts, "token", "left").groupBy("rule", "kind", "verdict").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token"))["token"].alias("token"))
    return rules.drop("tokens").join(rarest, ["rule", "kind", "verdict"], "left").select(F.col("kind"), "rank", "regex", F.coalesce("token", F.lit("")).alias("token")).distinct()


def judge(pages: DataFrame, rules: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", default: str = DEFAULT) -> DataFrame:
    """page_id, host, path, rule (of a host, that decided), verdict, pattern (that decided where no rule of a host fits)."""
    spark = pages.sparkSession
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("_url"))
    host, path, rest = url_parts(F.col("_url"))
    urls = rows.select("_url", F.concat(host, path).alias("at"), F.concat(host, lowered(path), lowered(rest)).alias("low"))
    index = materialize(rule_index(default_rules(spark) if rules is None else rules, urls), "url-rules")
    keys = F.array_append(url_tokens(F.col("low")), F.lit(""))
    fetched = urls.where("low <> ''").select("_url", "at", "low", F.explode(keys).alias("token")).join(index, "token")
    fits = fetched.where(F.rlike(F.when(F.col("kind") == "host", F.col("at")).otherwise(F.col("low")), F.col("regex")))
    best = fits.groupBy(F.col("_url").alias("_key")).agg(F.max("rank").alias("best"))
    judged = rows.join(best, F.col("_url") == F.col("_key"), "left")
    mine = F.col("best.host")
    return judged.select(
        "page_id", host.alias("host"), path.alias("path"), F.when(mine, F.col("best.rule")).alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"), F.when(~mine, F.col("best.rule")).alias("pattern"),
    )


def _pattern_regex(pattern: str) -> str:
    return "(?s)" + "".join({"*": ".*", "^": EDGE}.get(c, "\\" + c if not c.isalnum() else c) for c in pattern)


def _values(rows) -> str:
    return ", ".join("(" + ", ".join("'" + x.replace("'", "''") + "'" for x in row) + ")" for row in rows)


#: The same in DuckDB: every rule on every url.
SQL = rf"""
WITH hosts(verdict, rule, host, path) AS (VALUES {_values((v, r, r.partition("/")[0], "/" + r.partition("/")[2]) for v, r in RULES)}),
patterns(verdict, rule, regex) AS (VALUES {_values((v, r, _pattern_regex(r)) for v, r in PATTERNS)}),
p AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '{PARTS}', 1), '{UPPER}', '{LOWER}') AS host,
             regexp_extract(coalesce(url, ''), '{PARTS}', 2) AS path, regexp_extract(coalesce(url, ''), '{PARTS}', 3) AS rest, row_number() OVER () AS n FROM pages),
h AS (SELECT n, max((length(r.rule), r.verdict, r.rule)) AS best FROM p JOIN hosts r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path) GROUP BY n),
m AS (SELECT n, max((length(r.rule), r.verdict, r.rule)) AS best FROM p JOIN patterns r ON regexp_matches(p.host || translate(p.path || p.rest, '{UPPER}', '{LOWER}'), r.regex) GROUP BY n)
SELECT page_id, host, path, h.best[3] AS rule, coalesce(h.best[2], m.best[2], '{DEFAULT}') AS verdict, CASE WHEN h.best IS NULL THEN m.best[3] END AS pattern
FROM p LEFT JOIN h USING (n) LEFT JOIN m USING (n)
"""
