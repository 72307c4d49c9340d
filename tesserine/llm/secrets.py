"""Secret scans with corpus-wide ownership frequency (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserine.llm.common import keyed, row_key, settle, table

# The detectors. The first three are the base kinds, in the order in which ties are listed.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"  # a failing shorter run can hide no longer one: same matches as AKIA[A-Z0-9]+ of 18+
HEX = r"[0-9a-f]{16,}"
VENDOR = r"gh[pousr]_[A-Za-z0-9]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_(?:live|test)_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{30,}|eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"
KINDS = ("assign", "access", "hex", "vendor")
BASE = KINDS[:3]
#: A value in more different texts than this is a copied example, however few sources they have.
MAX_REPOSITORIES = 8
SPAN = "array<struct<start:int,k:int,end:int,value:string>>"
#: Matches that are put one behind another in a list of their own; lists are then joined once.
RUN = 64


def _found(text: Column, kind: int, pattern: str, group: int = 0, least: int = 0) -> Column:
    """Leftmost non-overlapping matches as (start, k, end, value), code points, end exclusive.

    split() gives the text between the matches, regexp_extract_all() the matches; the running length
    of both gives the places. Group `group` is the value; values shorter than `least` are dropped after
    matching, so that a failing match still uses up its characters. Lists grow in runs of RUN matches, so that
    a text with very many of them isn't copied for each.
    """
    between = F.split(text, pattern, -1)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    begun = lambda pos: F.struct(pos.alias("pos"), F.array().cast(SPAN).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["pos"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        value = F.regexp_extract(x["hit"], pattern, group) if group else x["hit"]
        span = F.struct(start.alias("start"), F.lit(kind).alias("k"), end.alias("end"), value.alias("value"))
        out = F.concat(acc["out"], F.array(span)) if not least else F.when(F.length(value) >= least, F.concat(acc["out"], F.array(span))).otherwise(acc["out"])
        return F.struct(end.cast("int").alias("pos"), out.cast(SPAN).alias("out"))

    pairs = F.zip_with(F.slice(between, F.lit(1), F.size(hits)), hits, lambda g, h: F.struct(g.alias("gap"), h.alias("hit")))
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(hits) - 1) / RUN).cast("int")), lambda i: F.slice(pairs, i * RUN + 1, F.lit(RUN)))
    joined = lambda acc, run: F.concat(acc, F.array(F.aggregate(run, begun(F.element_at(acc, -1)["pos"]), step)))
    spans = F.aggregate(runs, F.array(begun(F.lit(0))), joined, lambda acc: F.flatten(F.transform(acc, lambda run: run["out"])))
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast(SPAN))


def candidates(docs: DataFrame) -> DataFrame:
    """Adds `base` and `vendor`, arrays of (start, k, end, value). Null text counts as empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    found = F.concat(_found(text, 0, ASSIGN, 2, 12), _found(text, 1, ACCESS), _found(text, 2, HEX))
    return docs.withColumn("base", F.array_sort(found)).withColumn("vendor", _found(text, 3, VENDOR))


def live_looking(value: Column) -> Column:
    """Letters and digits, at least 8 different characters, and no placeholder's word."""
    varied = F.size(F.array_distinct(F.split(value, ""))) >= 8
    return varied & value.rlike("[0-9]") & value.rlike("[A-Za-z]") & ~value.rlike("(?i)example|changeme|placeholder|dummy|your_|xxxx")


def ownership(found: DataFrame, max_owners: int = 2, max_repositories: int = MAX_REPOSITORIES) -> DataFrame:
    """found(fingerprint, owner, repository, looks) -> one row a fingerprint: n_owners, n_repositories,
    and verdict: `live`, or `example` (more than max_owners owners carry it, more than max_repositories
    repositories hold it, or it looks like a placeholder).

    A repository that several owners have a copy of counts for the first of them only, so copies alone
    make no owners. Rows are first counted by (fingerprint, repository, owner) on the map side, so one
    string that a third of all documents carry is merged before it is dealt by fingerprint.
    """
    first = found.groupBy("fingerprint", "repository").agg(F.min("owner").alias("owner"), F.max("looks").alias("looks"))
    each = first.groupBy("fingerprint", "owner").agg(F.count(F.lit(1)).alias("n"), F.max("looks").alias("looks"))
    counted = each.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n_owners"), F.sum("n").alias("n_repositories"), F.max("looks").alias("looks"))
    few = (F.col("n_owners") <= max_owners) & (F.col("n_repositories") <= max_repositories)
    return counted.withColumn("verdict", F.when(F.col("looks") & few, "live").otherwise("example"))


def scan(docs: DataFrame, owner: Column | None = None, repository: Column | None = None, max_owners: int = 2, max_repositories: int = MAX_REPOSITORIES) -> DataFrame:
    """docs(doc_id, text, ...) -> one row a document: doc_id, _k1, _k2 (row key), base (spans),
    live (spans whose value belongs to few owners), n_example, added (vendor spans that are live).

    The owner defaults to `source`, the repository to the text itself (by 128 bits): copies of a document
    are one repository. A value in more owners' repositories than max_owners, or in more repositories than
    max_repositories, is a copied example. Null owners count as one owner. Repeated rows get equal results;
    null or empty text has no spans; an empty table gives no rows.
    """
    owner = F.col("source") if owner is None else owner
    repository = F.struct(*row_key("text")) if repository is None else repository
    k1, k2 = row_key("doc_id", "text")
    slim = docs.select("doc_id", k1.alias("_k1"), k2.alias("_k2"), F.coalesce(owner.cast("string"), F.lit("")).alias("owner"), repository.alias("repository"), "text")
    slim = settle(candidates(slim).drop("text"), "secret-spans")
    each = slim.filter((F.size("base") > 0) | (F.size("vendor") > 0)).select("_k1", "_k2", "owner", "repository", F.explode(F.concat("base", "vendor")).alias("s"))
    each = each.withColumn("fingerprint", F.unhex(F.sha2(F.col("s.value"), 256))).withColumn("looks", live_looking(F.col("s.value")))
    verdicts = ownership(each.select("fingerprint", "owner", "repository", "looks"), max_owners, max_repositories).select("fingerprint", "verdict")
    verdicts = settle(verdicts, "secret-verdicts")  # so that a string in very many documents can be split in the join
    judged = each.join(verdicts, "fingerprint").select("_k1", "_k2", "s", (F.col("verdict") == "live").alias("is_live"))
    # rows that are repeated share a key: a set, so that they don't multiply
    by_row = judged.groupBy("_k1", "_k2").agg(
        F.collect_set(F.when(F.col("is_live"), F.col("s"))).alias("live"), F.collect_set(F.when(~F.col("is_live"), F.col("s"))).alias("examples")
    )
    out = slim.join(by_row, ["_k1", "_k2"], "left")
    live = F.coalesce("live", F.array().cast(SPAN))
    return out.select(
        "doc_id", "_k1", "_k2", "base", F.array_sort(live).alias("live"), F.coalesce(F.size("examples"), F.lit(0)).alias("n_example"),
        F.filter(F.array_sort(live), lambda s: s["k"] >= len(BASE)).alias("added"),
    )


def redact(docs: DataFrame, mark: str = "<secret>", **options) -> DataFrame:
    """docs with each live credential's value replaced by `mark`; examples stay. Same columns, whatever their
    names (n_chars follows the text), all rows."""
    values = F.array_distinct(F.transform("live", lambda s: s["value"]))
    found = scan(docs, **options).filter(F.size("live") > 0).select(F.col("_k1").alias("k1"), F.col("_k2").alias("k2"), values.alias("values")).dropDuplicates(["k1", "k2"])
    joined = keyed(docs).join(settle(found, "secret-values"), ["k1", "k2"], "left")
    # the longest first: a value may hold another
    ordered = F.array_sort("values", lambda a, b: F.length(b) - F.length(a))
    text = F.aggregate(ordered, F.col("row.text"), lambda t, v: F.replace(t, v, F.lit(mark)))
    row = F.col("row").withField("text", text)
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.length(text).cast(docs.schema["n_chars"].dataType))
    return joined.select(F.when(F.col("values").isNull(), F.col("row")).otherwise(row).alias("row")).select("row.*")


def _listed(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat(F.element_at(kinds, s["k"] + 1), F.lit(":"), s["start"], F.lit(":"), s["end"])), ",")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    count = lambda k: F.size(F.filter("base", lambda s: s["k"] == k)).cast("long")
    return out.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(_listed(F.col("base")), 256).alias("base_sha256"),
        _listed(F.array_sort(F.concat("base", "added"))).alias("spans"), F.size("live").cast("long").alias("n_live"), F.col("n_example").cast("long").alias("n_example"),
    )


def _sql() -> str:
    quoted = lambda p: "'" + p.replace("'", "''") + "'"
    hits = " UNION ALL ".join(f"SELECT doc_id, owner, t, {k} AS k, regexp_extract_all(t, {quoted(p)}, 0) AS h, regexp_split_to_array(t, {quoted(p)}) AS g FROM d" for k, p in enumerate((ASSIGN, ACCESS, HEX, VENDOR)))
    name = f"([{', '.join(map(quoted, KINDS))}])[k + 1] || ':' || start || ':' || stop"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '') AS owner FROM documents),
hits AS ({hits}),
found AS (
  SELECT doc_id, owner, t, k, h[i] AS hit, CASE WHEN k = 0 THEN regexp_extract(h[i], {quoted(ASSIGN)}, 2) ELSE h[i] END AS value,
    (list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(h[1:i - 1], lambda x: length(x))), 0))::BIGINT AS start
  FROM hits, unnest(range(1, len(h) + 1)) AS u(i)),
spans AS (SELECT *, start + length(hit) AS stop FROM found WHERE k > 0 OR length(value) >= 12),
texts AS (SELECT value, t, min(owner) AS owner FROM spans GROUP BY value, t),
verdicts AS (
  SELECT value, count(DISTINCT owner) <= 2 AND count(*) <= {MAX_REPOSITORIES} AND len(list_distinct(string_split(value, ''))) >= 8 AND regexp_matches(value, '[0-9]')
    AND regexp_matches(value, '[A-Za-z]') AND NOT regexp_matches(value, '(?i)example|changeme|placeholder|dummy|your_|xxxx') AS live
  FROM texts GROUP BY value),
judged AS (SELECT doc_id, k, start, stop, live, {name} AS name FROM spans JOIN verdicts USING (value)),
listed AS (
  SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
    string_agg(name, ',' ORDER BY start, k, stop) FILTER (k < 3) AS base, string_agg(name, ',' ORDER BY start, k, stop) FILTER (k < 3 OR live) AS spans,
    count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_example
  FROM judged GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
  coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example
FROM d LEFT JOIN listed USING (doc_id)"""


OP8_SQL = _sql()
