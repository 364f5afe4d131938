"""Checking an export against what its manifest, index and commit say; every finding is a row (path, code)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import identity as I
from ..storage import durable
from .manifest import PORTABLE


def path_key(path: Column) -> Column:
    """Paths are compared with forward slashes and folding case."""
    return F.lower(F.replace(path, F.lit("\\"), F.lit("/")))


def safe_path(path: Column) -> Column:
    """A relative path that stays below its root."""
    plain = F.replace(path, F.lit("\\"), F.lit("/"))
    return I.not_blank(path) & ~plain.rlike(r"^(?:/|[A-Za-z]:)") & ~plain.rlike(r"(?:^|/)\.\.(?:/|$)")


def references(entries: DataFrame, order: str, original: tuple[str, str, str], decoded: tuple[str, str]) -> DataFrame:
    """One row for each file that an entry names: ``order``, kind, path, sha256, bytes; a decoded file has no known length."""
    path, sha, size = original
    files = [
        F.struct(F.lit("original").alias("kind"), F.col(path).alias("path"), F.col(sha).alias("sha256"), F.col(size).cast("long").alias("bytes")),
        F.struct(F.lit("decoded").alias("kind"), F.col(decoded[0]).alias("path"), F.col(decoded[1]).alias("sha256"), F.lit(None).cast("long").alias("bytes")),
    ]
    return entries.select(F.col(order).alias("order"), F.explode(F.array(*files)).alias("f")).select("order", "f.*").where((F.col("kind") == "original") | F.col("path").isNotNull())


def accepted_entries(refs: DataFrame) -> DataFrame:
    """``order`` of the entries whose original is accepted: its path is safe and no earlier reference that counts has it.

    Entries count in order. Every original counts; a decoded file counts only with its own original accepted. So an original
    that an earlier one has is refused at once, and of each path only the first original can depend on earlier decoded files;
    these few are settled in rounds, from the earliest on.
    """
    keyed = refs.select("order", "kind", safe_path(F.col("path")).alias("safe"), path_key(F.col("path")).alias("key")).where("safe")
    firsts = keyed.groupBy("key").agg(F.min(F.when(F.col("kind") == "original", F.col("order"))).alias("order"), F.min(F.when(F.col("kind") == "decoded", F.col("order"))).alias("decoded"))
    firsts = firsts.where(F.col("order").isNotNull())
    contested = durable(firsts.where(F.col("decoded") < F.col("order")).select("key", "order"))
    if contested.isEmpty():
        return firsts.select("order")
    free = firsts.where(F.coalesce(F.col("decoded") >= F.col("order"), F.lit(True))).select("order")
    before = keyed.where(F.col("kind") == "decoded").select("key", F.col("order").alias("by"))
    edges = contested.join(before, "key").where(F.col("by") < F.col("order")).select("order", "by")
    waiting = contested.select(F.col("order").alias("by"), F.lit(True).alias("waits"))
    edges = durable(edges.join(free.select(F.col("order").alias("by"), F.lit(True).alias("sure")), "by", "left").join(waiting, "by", "left"))
    settled = edges.where("false").select("order", F.lit(True).alias("accepted"))
    while True:
        known = edges.join(settled.select(F.col("order").alias("by"), F.col("accepted").alias("_a")), "by", "left")
        counts, open_ = F.coalesce("sure", "_a", F.lit(False)), F.col("waits") & F.col("_a").isNull()
        judged = known.groupBy("order").agg(F.bool_or(counts).alias("refused"), F.bool_or(F.coalesce(open_, F.lit(False))).alias("open"))
        now = durable(judged.where(F.col("refused") | ~F.col("open")).select("order", (~F.col("refused")).alias("accepted")))
        if now.count() == settled.count():
            break
        settled = now
    return free.unionByName(settled.where("accepted").select("order"))


def _placed(refs: DataFrame) -> DataFrame:
    """References that count, with their key and their number among those of the same file; originals come before decoded files
    of one entry, and the decoded file of an entry whose original is refused is not looked at."""
    accepted = accepted_entries(refs).select("order", F.lit(True).alias("_accepted"))
    live = refs.join(accepted, "order", "left").where((F.col("kind") == "original") | F.col("_accepted")).drop("_accepted")
    keyed = live.withColumns({"safe": safe_path(F.col("path")), "key": path_key(F.col("path"))})
    order = Window.partitionBy("key", "safe").orderBy("order", F.desc("kind"))
    return keyed.withColumn("nth", F.row_number().over(order))


def expected_files(refs: DataFrame) -> DataFrame:
    """key, kind, path, sha256, bytes of every file that is expected: the first reference that counts to each."""
    return _placed(refs).where(F.col("safe") & (F.col("nth") == 1)).select("key", "kind", "path", "sha256", "bytes")


def artifact_issues(refs: DataFrame, files: DataFrame) -> DataFrame:
    """(path, code) of the references against the inventory ``files`` (path, bytes, sha256, is_link).

    A decoded file that is named again is checked nevertheless, so it may have two findings. A link below ``original`` or
    ``decoded`` is a finding, whoever names it, and never an extra file.
    """
    found = files.select(path_key(F.col("path")).alias("key"), F.lit(True).alias("there"), F.col("bytes").alias("_bytes"), F.col("sha256").alias("_sha"), "is_link")
    placed = durable(_placed(refs))
    both = placed.join(found, "key", "left")
    there, original = F.coalesce("there", F.lit(False)), F.col("kind") == "original"
    same = F.lower("_sha").eqNullSafe(F.lower("sha256"))
    first = F.when(~F.col("safe"), "artifact-path-outside-root").when(F.col("nth") > 1, "artifact-duplicate")
    of_original = F.when(~there, "artifact-missing").when(F.col("is_link"), "artifact-reparse-point").when(~(same & F.col("_bytes").eqNullSafe(F.col("bytes"))), "artifact-hash-mismatch")
    of_decoded = F.when(F.col("sha256").isNotNull() & ~there, "decoded-missing").when(F.col("sha256").isNotNull() & ~same, "decoded-hash-mismatch")
    second = F.when(original & first.isNull(), of_original).when(~original & F.col("safe"), of_decoded)
    plain = F.when(F.col("safe"), F.replace("path", F.lit("\\"), F.lit("/"))).otherwise(F.col("path"))
    named = both.select(plain.alias("path"), F.explode(F.array_compact(F.array(first, second))).alias("code"))
    known = placed.where(F.col("safe") & (F.col("nth") == 1)).select("key")
    stored = files.withColumn("key", path_key(F.col("path"))).where(F.col("key").rlike("^(?:original|decoded)/"))
    links = stored.where("is_link").select("path", F.lit("artifact-reparse-point").alias("code"))
    extra = stored.where(~F.col("is_link")).join(known, "key", "left_anti").select("path", F.lit("artifact-extra").alias("code"))
    return named.unionByName(links).unionByName(extra)


def index_issues(index: DataFrame, expected: DataFrame, files: DataFrame) -> DataFrame:
    """(path, code) of an artifact index (line, path, bytes, sha256, file_id; a null path is a malformed line).

    ``expected`` comes from ``expected_files``; the length of a decoded file is that of the inventory. One row without a path
    says that the index does not cover exactly what is expected.
    """
    keyed = index.withColumns({"safe": safe_path(F.col("path")), "key": path_key(F.col("path"))})
    keyed = keyed.withColumn("nth", F.row_number().over(Window.partitionBy("key", "safe").orderBy("line")))
    lengths = files.select(path_key(F.col("path")).alias("key"), F.col("bytes").alias("_there"))
    wanted = expected.join(lengths, "key", "left").select("key", F.lower(F.coalesce("sha256", F.lit(""))).alias("_sha"), F.coalesce("bytes", "_there", F.lit(-1)).alias("_bytes"), F.lit(True).alias("wanted"))
    both = keyed.join(wanted, "key", "left")
    same = F.coalesce("wanted", F.lit(False)) & F.col("bytes").eqNullSafe(F.col("_bytes")) & F.lower("sha256").eqNullSafe(F.col("_sha")) & I.not_blank(F.col("file_id"))
    code = F.when(F.col("path").isNull(), "artifact-index-invalid").when(~F.col("safe"), "artifact-index-path-outside-root").when(F.col("nth") > 1, "artifact-index-duplicate").when(~same, "artifact-index-mismatch")
    named = both.select("path", code.alias("code")).where(F.col("code").isNotNull())
    listed = keyed.where(F.col("path").isNotNull() & F.col("safe")).select("key").distinct()
    apart = listed.join(expected, "key", "left_anti").select("key").unionByName(expected.join(listed, "key", "left_anti").select("key")).limit(1)  # one finding for all
    return named.unionByName(apart.select(F.lit(None).cast("string").alias("path"), F.lit("artifact-index-mismatch").alias("code")))


def hash_issues(expected: DataFrame, actual: DataFrame, key: str, sha: str, missing: str, mismatch: str) -> DataFrame:
    """(path, code) of files that are not there or whose hash differs, folding case."""
    there = actual.select(F.col(key).alias("_key"), F.col(sha).alias("_sha"), F.lit(True).alias("_there"))
    both = expected.join(there, F.col(key) == F.col("_key"), "left")
    code = F.when(F.col("_there").isNull(), missing).when(~F.lower("_sha").eqNullSafe(F.lower(sha)), mismatch)
    return both.select(F.col(key).alias("path"), code.alias("code")).where(F.col("code").isNotNull())


def commit_issues(descriptor: DataFrame, files: DataFrame, latest: DataFrame | None = None) -> DataFrame:
    """(path, code) of a run's commit: ``descriptor`` has run_id, selected_run, path, latest_path and sha256 of each of its
    files, ``files`` path and sha256 of what is there; with ``latest`` (the descriptor that the latest pointer holds) the
    aliases of the latest run are checked too."""
    run = descriptor.where(~F.col("run_id").eqNullSafe(F.col("selected_run"))).limit(1).select(F.lit(None).cast("string").alias("path"), F.lit("metadata-commit-run-mismatch").alias("code"))
    out = [run, hash_issues(descriptor, files, "path", "sha256", "metadata-commit-file-missing", "metadata-commit-hash-mismatch")]
    if latest is not None:
        aliases = descriptor.select(F.col("latest_path").alias("path"), "sha256")
        out.append(hash_issues(aliases, files, "path", "sha256", "metadata-latest-file-missing", "metadata-latest-file-mismatch"))
        own, other = (df.select("run_id", "path", "sha256") for df in (descriptor, latest))
        differs = own.exceptAll(other).unionByName(other.exceptAll(own)).limit(1)
        out.append(differs.select(F.lit(None).cast("string").alias("path"), F.lit("metadata-latest-mismatch").alias("code")))
    return reduce(DataFrame.unionByName, out)


def alias_issues(stored: DataFrame, derived: DataFrame, aliases: DataFrame, alias: str = "alias") -> DataFrame:
    """(path, code) of stored copies of a manifest that are missing or differ, as bags of rows, from the derived one.

    ``aliases`` holds the names that there should be; ``stored`` has the alias beside the rows' fields. An alias says the same if
    it has as many different rows as the derived manifest and each of them as often, so nothing is multiplied by the aliases.
    """
    fields = derived.columns
    wanted = derived.groupBy(*fields).agg(F.count("*").alias("_wanted"))
    total = wanted.agg(F.count("*").alias("_total"))
    own = stored.groupBy(F.col(alias).alias("_alias"), *[F.col(c).alias(f"_own{i}") for i, c in enumerate(fields)]).agg(F.count("*").alias("_stored"))
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_own{i}")) for i, c in enumerate(fields)])
    counted = own.join(wanted, same, "left").groupBy("_alias").agg(F.count("*").alias("_rows"), F.count_if(F.col("_stored") == F.col("_wanted")).alias("_same"))
    differs = counted.join(F.broadcast(total), (F.col("_rows") != F.col("_total")) | (F.col("_same") != F.col("_total")), "left_semi")  # one row
    missing = aliases.join(stored.select(alias).distinct(), alias, "left_anti").select(F.col(alias).alias("path"), F.lit("manifest-alias-missing").alias("code"))
    return missing.unionByName(differs.select(F.col("_alias").alias("path"), F.lit("manifest-alias-mismatch").alias("code")))


def canonical(document: Column, without: tuple[str, ...] = ()) -> Column:
    """A JSON object in one form: keys in order at every depth, without white space, nulls and the keys ``without``; null for text
    that is no JSON object. Equal documents have equal forms, whatever the order in which they were written."""
    value = F.try_parse_json(document)
    fields = F.when(F.schema_of_variant(value).startswith("OBJECT"), value).cast("map<string,variant>")
    kept = F.map_filter(fields, lambda k, v: ~F.is_variant_null(v) & ~k.isin(*without) if without else ~F.is_variant_null(v))
    return F.array_join(F.transform(F.array_sort(F.map_keys(kept)), lambda k: F.concat(k, F.lit("="), F.to_json(F.element_at(kept, k)))), "\n")


def document_issues(documents: DataFrame, manifest: str, journal: Column, namespace: str = "datasetNamespaceKey") -> DataFrame:
    """(path, code) of a run's documents (path, role, text): the one of role ``manifest`` must be there, be a JSON object and name its
    namespace; ``journal`` (the manifest that the journal reconstructs, as JSON) and the documents of role ``alias`` must say the same
    but for the namespace. A missing document has a null text."""
    roles = {"manifest": ("manifest-missing", "manifest-invalid", None), "alias": ("manifest-alias-missing", "manifest-alias-invalid", "manifest-alias-mismatch")}
    form = canonical(F.col("text"), (namespace,))
    told = documents.select("path", "role", "text", form.alias("form"), F.try_variant_get(F.try_parse_json("text"), f"$.{namespace}", "string").alias("namespace"))
    own = told.where((F.col("role") == "manifest") & (F.col("path") == manifest)).select(F.col("form").alias("wanted"), F.col("namespace").alias("own_namespace"))
    both = told.join(F.broadcast(own.limit(1)), F.lit(True), "left")  # one manifest
    code: Column = F.lit(None).cast("string")
    for role, (missing, invalid, mismatch) in roles.items():
        found = F.when(F.col("text").isNull(), missing).when(F.col("form").isNull(), invalid)
        found = found.when(F.col("wanted").isNotNull() & (F.col("form") != F.col("wanted")), mismatch) if mismatch else found
        code = F.when(F.col("role") == role, found).otherwise(code)
    of_manifest = (F.col("role") == "manifest") & F.col("form").isNotNull()
    names = F.when(of_manifest & ~F.coalesce(I.not_blank(F.col("namespace")), F.lit(False)), "portable-id-namespace-missing")
    replay = F.when(of_manifest & journal.isNotNull() & ~canonical(journal, (namespace,)).eqNullSafe(F.col("form")), "journal-manifest-mismatch")
    return both.select("path", F.explode(F.array_compact(F.array(code, names, replay))).alias("code"))


def commit_event_issues(journal: Column, commits: Column, descriptor_sha: Column, told_descriptor: Column, manifest_sha: Column, told_manifest: Column, rows: DataFrame) -> DataFrame:
    """(path, code) of one-row ``rows``: whether a journal (path) is committed, and whether its last commit event binds the
    descriptor's bytes, or in the older form, without a descriptor's hash, the manifest's."""
    fold = lambda a, b: F.lower(a).eqNullSafe(F.lower(b))
    code = (
        F.when(~F.coalesce(commits, F.lit(False)), "journal-not-committed")
        .when(I.not_blank(told_descriptor) & descriptor_sha.isNull(), "metadata-descriptor-missing").when(I.not_blank(told_descriptor) & ~fold(told_descriptor, descriptor_sha), "metadata-descriptor-hash-mismatch")
        .when(~F.coalesce(I.not_blank(told_descriptor), F.lit(False)) & ~fold(told_manifest, manifest_sha), "manifest-hash-mismatch")
    )
    return rows.select(journal.alias("path"), code.alias("code")).where(F.col("code").isNotNull())


def csv_issues(rows: DataFrame, manifest: DataFrame, path: str) -> DataFrame:
    """(path, code) of a portable CSV (``csv_rows``; line_no 0 is the header) against the manifest's portable rows, whose flags are
    joined by ``|``. Only a header as it should be lets the rows be looked at; an empty file has none.

    A line without eight fields, or of an id that an earlier line has (folding case), is invalid; the first of each id counts.
    """
    first = rows.agg(F.min_by(F.struct("valid", *PORTABLE), "line_no").alias("h"))
    good = F.coalesce(F.col("h.valid") & reduce(Column.__and__, [F.col(f"h.{c}") == c for c in PORTABLE]), F.lit(False))
    head = first.select(good.alias("good"))
    least = F.broadcast(rows.agg(F.min("line_no").alias("_least")))
    body = rows.join(least, F.col("line_no") > F.col("_least")).join(F.broadcast(head.where("good").select(F.lit(True).alias("_good"))), F.lit(True)).drop("_least", "_good")
    body = body.withColumn("key", F.lower("item_id"))
    firsts = body.where("valid").groupBy("key").agg(F.min("line_no").alias("_first"))
    counted = body.join(firsts, "key", "left")
    invalid = counted.where(~F.col("valid") | (F.col("line_no") != F.col("_first"))).select(F.lit("csv-row-invalid").alias("code"))
    actual = counted.where(F.col("valid") & (F.col("line_no") == F.col("_first"))).select("key", F.struct(*PORTABLE[1:]).alias("has"))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    wanted = manifest.select(F.lower("item_id").alias("key"), F.struct(*[text(c).alias(c) for c in PORTABLE[1:]]).alias("wants"))
    both = wanted.join(F.broadcast(head.where("good").select(F.lit(True).alias("_good"))), F.lit(True)).join(actual, "key", "full_outer")
    fold = ("sha256", "selected")
    same = reduce(Column.__and__, [(F.lower(f"has.{c}") == F.lower(f"wants.{c}")) if c in fold else (F.col(f"has.{c}") == F.col(f"wants.{c}")) for c in PORTABLE[1:]])
    differs = both.select(F.when(F.col("has").isNull(), "csv-row-missing").when(F.col("wants").isNull(), None).when(~same, "csv-json-mismatch").alias("code")).where("code IS NOT NULL")
    extra = both.where("wants IS NULL").limit(1).select(F.lit("csv-row-extra").alias("code"))  # one finding for all
    header = head.where(~F.col("good")).select(F.lit("csv-header-invalid").alias("code"))
    return reduce(DataFrame.unionByName, (header, invalid, differs, extra)).select(F.lit(path).alias("path"), "code")


def repair_gate(commits: Column, issues: DataFrame, code: str = "code") -> DataFrame:
    """One row: whether a repair may rebuild derived metadata. The journal must be committed and nothing be wrong."""
    counted = issues.agg(F.count("*").alias("issues"), F.count_if(F.col(code) == "artifact-missing").alias("missing"), F.count_if(F.col(code) == "artifact-extra").alias("extra"))
    return counted.withColumn("allowed", F.coalesce(commits, F.lit(False)) & (F.col("issues") == 0))
