"""Secret scans with corpus-wide ownership frequency.

Base spans are three patterns: assignments to secret-like names, access key ids and long runs
of hexadecimal digits. The method looks for further candidates (long runs of token characters
that mix upper case, lower case and digits, and keys with known prefixes), hashes the value of
every candidate and counts the distinct repositories and owners that hold it in the whole
corpus. A value that several owners share is an example that was copied about; a value of one
owner alone, in however many of its repositories, is live-looking, and its spans are added. Base spans
stay whatever their count; n_live and n_example tell how many values of either kind a document holds.

Who owns a row is for the caller to say: `repo` and `owner` are column expressions. Left out,
the repository is the column source, and its owner what stands before the first slash of it.

Positions come from SQL functions alone: the pieces between matches (split) and the matches
(regexp_extract_all) alternate, so running sums of their lengths give code-point offsets. A text is scanned
once: the spans, with hashes in place of values, are stored under a number for each row.

Occurrences are reduced to distinct (value, repository, owner) rows before they are counted.
Verdicts go back to the rows by two joins: values with more than HOT_ROWS holders are broadcast
(their number is checked), the others meet their few holders by a shuffle.

Defined results:
- null or empty text: no spans; base_sha256 of the empty string; spans is '';
- null repository or owner: counted as one repository or owner of its own;
- null ids and repeated rows: each row is scanned by itself; a row holds its own number throughout;
- other columns are ignored by scan_secrets and carried along by redact, whatever their names; an empty table gives
  an empty result;
- ties: spans that begin together are ordered by kind, then end;
- long texts are scanned whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, stored

#: (kind, pattern, group that must be long, least length), in the order of the kinds.
BASE = (
    ("assign", r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"(AKIA[A-Z0-9]+)", 1, 20),
    ("hex", r"([0-9a-f]+)", 1, 24),
)
EXTRA = (
    ("prefixed", r"((?:gh[pousr]_|glpat-|xox[abprs]-|sk_live_|rk_live_|AIza|eyJ)[A-Za-z0-9_.-]+)", 1, 20),
    ("mixed", r"([A-Za-z0-9+/_=-]+)", 1, 24),
)
KINDS = [k for k, *_ in (*BASE, *EXTRA)]
#: A value of more owners than this is an example; one that more rows than HOT_ROWS hold is joined by a broadcast.
MAX_OWNERS, HOT_ROWS = 1, 100_000
_SPANS = "array<struct<s:int,k:int,e:int,v:string>>"


def _spans(text: Column, kind: str, pattern: str, group: int, least: int) -> Column:
    """array<struct<s, k, e, v>>: the matches of one kind; s and e are code points, v the value."""
    if kind in ("hex", "mixed"):  # runs of one class: only long ones can pass, and shorter ones hide nothing
        pattern = pattern.replace("]+", f"]{{{least},}}")
    whole = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    gaps = F.transform(F.split(text, pattern), F.length)
    order = KINDS.index(kind)
    steps = F.arrays_zip(F.slice(gaps, 1, F.size(whole)).alias("g"), whole.alias("m"), value.alias("v"))
    start = F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as {_SPANS})").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + x["g"]
        e = s + F.length(x["m"])
        return F.struct(e.alias("at"), F.concat(acc["out"], F.array(F.struct(s.alias("s"), F.lit(order).alias("k"), e.alias("e"), x["v"].alias("v")))).alias("out"))

    return F.filter(F.aggregate(steps, start, step)["out"], lambda x: F.length(x["v"]) >= least)


def _mixed(value: Column) -> Column:
    return value.rlike("[A-Z]") & value.rlike("[a-z]") & value.rlike("[0-9]")


def _text_of(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"], x["e"])), ",")


def _found(rows: DataFrame, keep_text: bool) -> DataFrame:
    """rows(row, text, repo, owner), stored, with number, base and extra: spans by start, then kind; v is the hash of the value.

    Without keep_text the stored rows have no text.
    """
    none = F.expr(f"cast(array() as {_SPANS})")

    def kinds(table: tuple) -> Column:
        each = []
        for k, p, g, n in table:
            sign = p if k not in ("hex", "mixed") else p.replace("]+", f"]{{{n},}}")
            each.append(F.when(F.col("text").rlike(sign), _spans(F.col("text"), k, p, g, n)).otherwise(none))
        return F.array_sort(F.concat(*each))

    hashed = lambda spans: F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"), F.sha2(x["v"], 256).alias("v")))
    apart = lambda x: ~F.exists("raw_base", lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"])) & ((x["k"] == KINDS.index("prefixed")) | _mixed(x["v"]))
    out = rows.withColumns({"raw_base": kinds(BASE), "raw_extra": kinds(EXTRA)})
    out = out.withColumns({"base": hashed(F.col("raw_base")), "extra": hashed(F.filter("raw_extra", apart)), "number": F.monotonically_increasing_id()})
    return stored(out.drop("raw_base", "raw_extra", *[] if keep_text else ["text"]))


def verdicts(found: DataFrame, max_owners: int = MAX_OWNERS) -> DataFrame:
    """hash, n_rows, n_repos, n_owners and live of every candidate value in the corpus; found has repo, owner, base and extra."""
    seen = found.select("repo", "owner", F.explode(F.array_distinct(F.transform(F.concat("base", "extra"), lambda x: x["v"]))).alias("hash"))
    once = seen.groupBy("hash", "repo", "owner").agg(F.count(F.lit(1)).alias("n"))
    counts = once.groupBy("hash").agg(F.sum("n").alias("n_rows"), F.count_distinct("repo").alias("n_repos"), F.count_distinct("owner").alias("n_owners"))
    return counts.withColumn("live", F.col("n_owners") <= max_owners)


def judged(found: DataFrame, max_owners: int = MAX_OWNERS) -> DataFrame:
    """The rows of a stored _found with `all` (base spans and those of live values), n_live and n_example."""
    known = stored(verdicts(found, max_owners))
    some = (F.size("base") > 0) | (F.size("extra") > 0)
    held = found.where(some).select("number", F.explode(F.array_distinct(F.transform(F.concat("base", "extra"), lambda x: x["v"]))).alias("hash"))
    hot = known.where(F.col("n_rows") > HOT_ROWS).select("hash", "live")
    n_hot = hot.limit(BROADCAST_IDS + 1).count()
    rest = known.select("hash", "live")
    if n_hot == 0:
        told = held.join(rest, "hash")
    elif n_hot <= BROADCAST_IDS:
        told = held.join(F.broadcast(hot), "hash").unionByName(held.join(F.broadcast(hot), "hash", "left_anti").join(rest, "hash"))
    else:
        told = held.join(rest, "hash")  # an adaptive skew join splits the hot ones
    each = told.groupBy("number").agg(F.collect_list(F.when(F.col("live"), F.col("hash"))).alias("live_hashes"), F.count_if("live").alias("n_live"), F.count_if(~F.col("live")).alias("n_example"))
    added = F.filter("extra", lambda x: F.array_contains("live_hashes", x["v"]))
    hits = found.where(some).join(each, "number").withColumn("all", F.array_sort(F.concat("base", added))).drop("live_hashes")
    none = found.where(~some).withColumns({"n_live": F.lit(0).cast("long"), "n_example": F.lit(0).cast("long"), "all": F.col("base")})
    return hits.unionByName(none)


def _columns(docs: DataFrame, text_col: str, repo: Column | None, owner: Column | None) -> dict[str, Column]:
    repo = F.col("source") if repo is None else repo
    owner = F.substring_index(repo.cast("string"), "/", 1) if owner is None else owner
    return {"text": F.coalesce(F.col(text_col).cast("string"), F.lit("")), "repo": F.coalesce(repo.cast("string"), F.lit("")), "owner": F.coalesce(owner.cast("string"), F.lit(""))}


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo: Column | None = None, owner: Column | None = None, max_owners: int = MAX_OWNERS) -> DataFrame:
    """One row for each document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example."""
    rows = docs.select(F.col(id_col).alias("row"), *[c.alias(k) for k, c in _columns(docs, text_col, repo, owner).items()])
    marked = judged(_found(rows, keep_text=False), max_owners)
    count = lambda k: F.size(F.filter("base", lambda x: x["k"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return marked.select(F.col("row").alias("doc_id"), *[count(k) for k, *_ in BASE], F.sha2(_text_of(F.col("base")), 256).alias("base_sha256"), _text_of(F.col("all")).alias("spans"), "n_live", "n_example")


def redact(docs: DataFrame, text_col: str = "text", mask: str = "<secret>", repo: Column | None = None, owner: Column | None = None, max_owners: int = MAX_OWNERS) -> DataFrame:
    """docs with every span of their texts replaced by the mask; overlapping spans are replaced together."""
    rows = docs.select(F.struct("*").alias("row"), *[c.alias(k) for k, c in _columns(docs, text_col, repo, owner).items()])
    marked = judged(_found(rows, keep_text=True), max_owners)
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        inside = x["s"] < acc["at"]
        piece = F.when(inside, F.lit("")).otherwise(F.concat(F.substring(F.col("text"), acc["at"] + 1, x["s"] - acc["at"]), F.lit(mask)))
        return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), F.concat(acc["out"], piece).alias("out"))

    cut = F.aggregate("all", start, step)
    clean = F.when(F.size("all") > 0, F.concat(cut["out"], F.substring(F.col("text"), cut["at"] + 1, F.length("text")))).otherwise(F.col("row").getField(text_col))
    return marked.select(*[(clean if c == text_col else F.col("row").getField(c)).alias(c) for c in docs.columns])
