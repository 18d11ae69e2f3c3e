"""Archives as tables: entries, safety limits, inventory, input resolution."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.rules import entry_kind, file_name, safe_member, split_type
from ..operators.taxonomy import DEFAULT_TAXONOMY, classify, in_taxonomy_order, names
from ..session import ship_package

BUNDLE_EXTENSIONS = (".apkm", ".apks", ".xapk")


@dataclass(frozen=True)
class Limits:
    entries: int = 100_000
    total_bytes: int = 3_000_000_000
    entry_bytes: int = 1_000_000_000


def read_archives(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(archive, size, content) of files below a folder. A file is one row, so at most 2 GB."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.select(F.col("path").alias("archive"), F.col("length").alias("size"), "content")


ENTRY = "archive string, path string, entry_size long, is_dir boolean, sha256 string, bytes binary, error string"


def entries(archives: DataFrame, prefix_bytes: int = 0, hashes: bool = False) -> DataFrame:
    """A row an archive entry: (archive, path, entry_size, is_dir, sha256, bytes, error).

    The directory is read without inflating anything; prefix_bytes > 0 also reads that much of each
    entry and hashes=True its SHA-256. A file that is no archive gives one row with error.
    """
    ship_package(archives.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        schema = pa.schema([("archive", pa.string()), ("path", pa.string()), ("entry_size", pa.int64()), ("is_dir", pa.bool_()), ("sha256", pa.string()), ("bytes", pa.binary()), ("error", pa.string())])
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = []
                try:
                    with zipfile.ZipFile(io.BytesIO(content.as_py() or b"")) as z:
                        for info in z.infolist():
                            data, digest, error = None, None, None
                            if (prefix_bytes or hashes) and not info.is_dir():
                                try:
                                    with z.open(info) as f:
                                        data, h = bytearray(), hashlib.sha256()
                                        while part := f.read(1 << 20):
                                            h.update(part)
                                            if len(data) < prefix_bytes:
                                                data += part[: prefix_bytes - len(data)]
                                        data, digest = bytes(data), h.hexdigest()
                                except Exception as e:  # noqa: BLE001 - a broken entry is a row with its error
                                    error = f"entry_error:{type(e).__name__}"
                            rows.append((name, info.filename, info.file_size, info.is_dir(), digest, data, error))
                except Exception as e:  # noqa: BLE001 - a broken archive is a row with its error
                    rows = [(name, None, None, None, None, None, f"invalid_zip:{type(e).__name__}")]
                if not rows:
                    rows = [(name, None, None, None, None, None, None)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return archives.select("archive", "content").mapInArrow(run, ENTRY)


def check_limits(rows: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(archive, entry_count, total_bytes, zip_error): the first limit an archive breaks, or null."""
    safe = F.when(F.col("path").isNotNull(), safe_member(F.col("path")))
    per = rows.groupBy("archive").agg(
        F.count("path").alias("entry_count"), F.coalesce(F.sum("entry_size"), F.lit(0)).alias("total_bytes"), F.max("error").alias("__e"), F.max("entry_size").alias("__m"),
        F.min(F.when(~safe, F.col("path"))).alias("__unsafe"),
    )
    error = (
        F.when(F.col("__e").isNotNull(), F.col("__e")).when(F.col("entry_count") > limits.entries, "too_many_entries")
        .when(F.col("__unsafe").isNotNull(), F.concat(F.lit("unsafe_member:"), "__unsafe")).when(F.col("__m") > limits.entry_bytes, "entry_too_large")
        .when(F.col("total_bytes") > limits.total_bytes, "archive_too_large")
    )
    return per.select("archive", "entry_count", "total_bytes", error.alias("zip_error"))


def inventory(rows: DataFrame, primary: str | None = None, limits: Limits = Limits()) -> DataFrame:
    """One record an archive: split type, counts by entry kind, capabilities, validation errors, success.

    Capabilities come from all entry paths. success needs a sound archive with a non-empty manifest.
    """
    from ..operators.quality import archive_status

    files = rows.where("path is not null and not is_dir").withColumn("hits", names(classify(F.col("path"))))
    files = files.withColumn("kind", entry_kind(F.col("path"), F.size("hits") > 0))
    of = lambda k: F.count_if(F.col("kind") == k)
    caps = files.select("archive", F.explode("hits").alias("c")).groupBy("archive").agg(F.collect_set("c").alias("c"))
    per = files.groupBy("archive").agg(
        of("dex").alias("dex_count"), of("native").alias("native_library_count"), of("model").alias("model_file_count"), of("resource").alias("resource_candidate_count"),
        F.coalesce(F.bool_or(F.col("kind") == "manifest"), F.lit(False)).alias("manifest_present"), F.coalesce(F.bool_or((F.col("kind") == "manifest") & (F.col("entry_size") > 0)), F.lit(False)).alias("manifest_readable"),
    )
    full = check_limits(rows, limits).join(per, "archive", "left").join(caps, "archive", "left")
    counts = ("dex_count", "native_library_count", "model_file_count", "resource_candidate_count")
    full = full.withColumns({c: F.coalesce(c, F.lit(0)) for c in counts} | {c: F.coalesce(c, F.lit(False)) for c in ("manifest_present", "manifest_readable")})
    full = full.withColumn("split_type", split_type(F.col("archive"))).withColumn("capabilities", in_taxonomy_order(F.col("c"), DEFAULT_TAXONOMY)).drop("c")
    full = full.withColumn("is_primary", F.lit(False) if primary is None else F.col("archive") == primary)
    return archive_status(full)


def split_summary(records: DataFrame) -> DataFrame:
    """One row over all archives: counts, kinds and whether there are splits."""
    return records.agg(
        F.count("*").alias("archives"), (F.count("*") > 1).alias("has_splits"), F.count_if(F.col("dex_count") > 0).alias("dex_archives"), F.count_if(F.col("native_library_count") > 0).alias("native_archives"),
        F.count_if(F.col("model_file_count") > 0).alias("model_archives"), F.count_if(~F.col("success")).alias("invalid_archives"), F.array_sort(F.collect_set("split_type")).alias("split_types"),
    )


def is_bundle(name: Column, has_nested: Column) -> Column:
    """A bundle by extension, or an archive of another extension than .apk that holds archives."""
    low = F.lower(file_name(name))
    by_name = F.lit(False)
    for e in BUNDLE_EXTENSIONS:
        by_name = by_name | F.endswith(low, F.lit(e))
    return by_name | (~F.endswith(low, F.lit(".apk")) & has_nested)


def nested_archives(archives: DataFrame) -> DataFrame:
    """(archive, size, content) of the .apk members of bundles, under their base names; unsafe paths are left out."""
    rows = entries(archives, prefix_bytes=1_000_000_000).where("path is not null and not is_dir").where(safe_member(F.col("path")) & F.endswith(F.lower("path"), F.lit(".apk")))
    return rows.select(file_name(F.col("path")).alias("archive"), F.col("entry_size").alias("size"), F.col("bytes").alias("content"), F.col("archive").alias("bundle"))


def select_primary(archives: DataFrame) -> DataFrame:
    """The primary archive of (archive, size, has_dex): base.apk, else the largest with code, else the largest; ties by path."""
    base = (F.lower(file_name(F.col("archive"))) == "base.apk").cast("int")
    return archives.orderBy(base.desc(), F.col("has_dex").cast("int").desc(), F.desc("size"), "archive").limit(1)


def native_archives(archives: DataFrame, primary: DataFrame) -> DataFrame:
    """Archives with native libraries, or the primary one if there are none."""
    native = archives.where("native_library_count > 0")
    none = native.limit(1).agg((F.count("*") == 0).alias("none"))
    # a one-row flag: both sides stay distributed
    fallback = archives.join(primary.select("archive"), "archive", "left_semi").crossJoin(F.broadcast(none)).where("none").drop("none")
    return native.unionByName(fallback)


def native_entries(rows: DataFrame) -> DataFrame:
    """(archive, path, abi, name, entry_size) of lib/<abi>/*.so entries."""
    low = F.lower("path")
    libs = rows.where(F.startswith(low, F.lit("lib/")) & F.endswith(low, F.lit(".so")) & safe_member(F.col("path")))
    return libs.select("archive", "path", F.get(F.split("path", "/"), F.lit(1)).alias("abi"), file_name(F.col("path")).alias("name"), "entry_size")


def verified(selected: DataFrame, files: DataFrame, key: str = "path") -> DataFrame:
    """selected(path, sha256, ...) with skipped: null where the file's content still has that hash, else the reason.

    files(path, content), as Spark's binaryFile source gives them; contents are hashed on the executors.
    """
    now = files.select(F.col(key), F.sha2("content", 256).alias("__now"))
    why = F.when(F.col("__now").isNull(), "library_file_missing").when(F.col("__now") != F.lower("sha256"), "library_hash_mismatch")
    return selected.join(now, key, "left").withColumn("skipped", why).drop("__now")


def dex_classes(data: Column) -> Column:
    """Class definitions in a DEX header (little-endian 32-bit number at 0x60); null for other data."""
    b = lambda i: F.hex(F.substring(data, 0x61 + i, 1))
    whole = (F.octet_length(data) >= 0x64) & (F.hex(F.substring(data, 1, 4)) == "6465780A")
    return F.when(whole, F.conv(F.concat(b(3), b(2), b(1), b(0)), 16, 10).cast("long"))


def text_files(spark: SparkSession, path: str, extensions: tuple[str, ...] = (".java", ".kt", ".xml")) -> DataFrame:
    """(file, text, size) of source files below a folder; bytes that are no UTF-8 are replaced."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    ok = F.lit(False)
    for e in extensions:
        ok = ok | F.endswith(F.lower("path"), F.lit(e))
    root = path.rstrip("/").removeprefix("file://")
    file = F.regexp_replace(F.col("path"), f"^(file:)?/*{root.lstrip('/')}/", "")
    return files.where(ok).select(file.alias("file"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"), F.col("length").alias("size"))


def by_extension(files: DataFrame) -> DataFrame:
    """(extension, files, bytes) of (file, size)."""
    ext = F.lower(F.regexp_extract("file", r"(\.[^./]+)$", 1))
    return files.groupBy(ext.alias("extension")).agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


def elf_symbols(listing: Column) -> Column:
    """Symbols in `readelf -Ws` text: exported functions with address, size, type, binding and section.

    Versions after @ go; undefined symbols, other types and names over 200 characters are left out.
    """
    line = r"^\s*\d+:\s+([0-9A-Fa-f]+)\s+(0x[0-9A-Fa-f]+|\d+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)"

    def parse(x: Column) -> Column:
        g = lambda k: F.regexp_extract(x, line, k)
        name = F.regexp_replace(g(7), "@.*", "")
        size = F.when(F.startswith(g(2), F.lit("0x")), F.conv(F.substring(g(2), 3, 30), 16, 10)).otherwise(g(2)).try_cast("long")
        address = F.concat(F.lit("0x"), F.lower(F.regexp_replace(g(1), "^0+(?=.)", "")))
        keep = F.regexp_like(x, F.lit(line)) & (g(3) == "FUNC") & (g(6) != "UND") & (F.length(name) <= 200)
        return F.when(keep, F.struct(name.alias("name"), address.alias("address"), size.alias("size_bytes"), g(3).alias("symbol_type"), g(4).alias("binding"), g(6).alias("section"), F.startswith(name, F.lit("Java_")).alias("is_jni")))

    return F.array_compact(F.transform(F.split(F.coalesce(listing, F.lit("")), "\n"), parse))


def ordered(rows: DataFrame, group: str, order: str, name: str = "ord") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(group).orderBy(order)))
