"""Dictionaries on disk: Parquet, JSON maps, and encrypted originals."""

from __future__ import annotations

import hashlib
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_JSON_SCHEMA = (
    "version string, created string, files array<string>, original_file string, ghost_file string, "
    "original_comments map<string,string>, "
    "symbols map<string,struct<original:string,kind:string,scope:string,files:array<string>>>, "
    "warnings array<struct<type:string,symbol:string,line:int,file:string,detail:string>>"
)


def write_dictionary(dictionary: DataFrame, path: str) -> None:
    """Parquet, one folder per prefix, so that a lookup by token reads one folder only."""
    dictionary.write.mode("errorifexists").partitionBy("prefix").parquet(path)


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    columns = ["token", "prefix", "seq", "original", "kind", "scope", "n_docs"]
    return spark.read.parquet(path).select(*columns)


def _maps(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_JSON_SCHEMA).json(path, multiLine=True).select(
        "*", F.col("_metadata.file_path").alias("map_file")
    )


def read_json_maps(spark: SparkSession, path: str) -> DataFrame:
    """Entries of JSON map files, one row per token; missing scope and files get defaults."""
    entries = _maps(spark, path).select("map_file", F.explode("symbols").alias("token", "e"))
    files = F.coalesce("e.files", F.array().cast("array<string>"))
    return entries.select(
        "map_file",
        "token",
        F.substring_index("token", "_", 1).alias("prefix"),
        F.substring_index("token", "_", -1).cast("bigint").alias("seq"),
        F.col("e.original").alias("original"),
        F.col("e.kind").alias("kind"),
        F.coalesce("e.scope", F.lit("")).alias("scope"),
        files.alias("files"),
        F.greatest(F.size(files), F.lit(1)).cast("bigint").alias("n_docs"),
    )


def read_json_warnings(spark: SparkSession, path: str) -> DataFrame:
    return _maps(spark, path).select("map_file", F.explode("warnings").alias("w")).select("map_file", "w.*")


def read_json_comments(spark: SparkSession, path: str) -> DataFrame:
    """(map_file, token, original) of the comments kept beside a map."""
    return _maps(spark, path).select("map_file", F.explode("original_comments").alias("token", "original"))


def read_json_headers(spark: SparkSession, path: str) -> DataFrame:
    return _maps(spark, path).select(
        "map_file",
        F.coalesce("version", F.lit("1.0")).alias("version"),
        F.coalesce("created", F.lit("")).alias("created"),
        F.coalesce("files", F.array().cast("array<string>")).alias("files"),
        F.coalesce("original_file", F.lit("")).alias("original_file"),
        F.coalesce("ghost_file", F.lit("")).alias("ghost_file"),
    )


_LINE_SCHEMA = (
    "record string, version string, created string, token string, original string, kind string, scope string, "
    "n_docs bigint, file string"
)


def write_json_lines(dictionary: DataFrame, path: str, files: DataFrame | None = None) -> None:
    """One JSON object per line, at every size: a ``map`` line with version and time, an ``entry`` line per
    token, and a ``file`` line per (token, file)."""
    spark = dictionary.sparkSession
    header = spark.range(1).select(
        F.lit("map").alias("record"),
        F.lit("1.0").alias("version"),
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("created"),
    )
    entries = dictionary.select(F.lit("entry").alias("record"), "token", "original", "kind", "scope", "n_docs")
    lines = header.unionByName(entries, allowMissingColumns=True)
    if files is not None:
        each = files.select(F.lit("file").alias("record"), "token", "file")
        lines = lines.unionByName(each, allowMissingColumns=True)
    lines.write.mode("errorifexists").json(path)


def read_json_lines(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What ``write_json_lines`` wrote: the dictionary, (token, file) rows, and (version, created)."""
    lines = spark.read.schema(_LINE_SCHEMA).json(path)
    entries = lines.where("record = 'entry'").select(
        "token",
        F.substring_index("token", "_", 1).alias("prefix"),
        F.substring_index("token", "_", -1).cast("bigint").alias("seq"),
        "original",
        "kind",
        "scope",
        "n_docs",
    )
    return (
        entries,
        lines.where("record = 'file'").select("token", "file"),
        lines.where("record = 'map'").select("version", "created"),
    )


def export_json_map(dictionary: DataFrame, path: str, files: DataFrame | None = None) -> None:
    """The whole dictionary as the single JSON object that other tools expect.

    One object is written by one task, which holds all of it: for dictionaries that such a tool could
    load. ``write_json_lines`` has no such limit. ``files`` is (token, file).
    """
    entries = dictionary.select("token", "original", "kind", "scope")
    empty = F.array().cast("array<string>")
    if files is None:
        with_files = entries.withColumn("files", empty)
    else:
        listed = files.groupBy("token").agg(F.array_sort(F.collect_set("file")).alias("files"))
        with_files = entries.join(listed, "token", "left").withColumn("files", F.coalesce("files", empty))
    entry = F.struct("original", "kind", "scope", "files")
    (
        with_files.agg(
            F.map_from_entries(F.array_sort(F.collect_list(F.struct("token", entry.alias("e"))))).alias("symbols"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("files")))).alias("files"),
        )
        .select(
            F.lit("1.0").alias("version"),
            F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("created"),
            "files",
            "symbols",
            F.array().cast("array<string>").alias("warnings"),
        )
        .coalesce(1)
        .write.mode("errorifexists")
        .json(path)
    )


# --- encryption ---------------------------------------------------------------------------

SALT_SIZE = 16
KDF_ROUNDS = 100_000


def derive_key(passphrase: str, salt: bytes) -> bytes:
    """A 256-bit key by PBKDF2-HMAC-SHA256; done once on the driver."""
    return hashlib.pbkdf2_hmac("sha256", passphrase.encode(), salt, KDF_ROUNDS, 32)


def key_column(spark: SparkSession, key: bytes) -> Column:
    """A key as the value of a one-row table.

    The row is data and not a literal, so the key stands in no plan, no event log and no generated code.
    """
    return spark.createDataFrame([(bytearray(key),)], "key binary").scalar()


def encrypt_col(column: Column, key: Column) -> Column:
    """AES-GCM with a fresh nonce per value."""
    return F.aes_encrypt(column.cast("binary"), key, F.lit("GCM"))


def decrypt_col(column: Column, key: Column) -> Column:
    """The plain bytes, or null for a wrong key or damaged data."""
    return F.try_aes_decrypt(column, key, F.lit("GCM"))


def wrap_key(spark: SparkSession, data_key: bytes, passphrase: str, salt: bytes) -> bytes:
    """The data key, encrypted with the key that passphrase and salt give."""
    row = spark.createDataFrame([(bytearray(data_key), bytearray(derive_key(passphrase, salt)))], "data binary, outer binary")
    return bytes(row.select(encrypt_col(F.col("data"), F.col("outer")).alias("w")).first()["w"])


def unwrap_key(spark: SparkSession, wrapped: bytes, passphrase: str, salt: bytes) -> bytes:
    """The data key again; ValueError if the passphrase is wrong."""
    if len(salt) < SALT_SIZE:
        raise ValueError("encrypted data is too short, the file may be corrupted")
    row = spark.createDataFrame([(bytearray(wrapped), bytearray(derive_key(passphrase, salt)))], "w binary, outer binary")
    plain = row.select(decrypt_col(F.col("w"), F.col("outer")).alias("k")).first()["k"]
    if plain is None:
        raise ValueError("decryption failed: wrong passphrase or corrupted data")
    return bytes(plain)


def encrypt_dictionary(dictionary: DataFrame, passphrase: str, salt: bytes | None = None) -> DataFrame:
    """Original, kind and scope as one encrypted column beside the token.

    Each dictionary has a data key of its own. The key is stored with it, wrapped by the passphrase's key, and the salt
    in clear: a new passphrase wraps the same key anew (``rewrap``) and leaves the entries as they are.
    """
    spark, salt = dictionary.sparkSession, salt or os.urandom(SALT_SIZE)
    data_key = os.urandom(32)
    wrapped = wrap_key(spark, data_key, passphrase, salt)
    secret = F.to_json(F.struct("original", "kind", "scope"))
    return dictionary.select(
        "token",
        "prefix",
        "seq",
        "n_docs",
        encrypt_col(secret, key_column(spark, data_key)).alias("secret"),
        F.lit(bytearray(salt)).alias("salt"),
        F.lit(bytearray(wrapped)).alias("wrapped_key"),
    )


def _data_key(encrypted: DataFrame, passphrase: str) -> bytes:
    first = encrypted.select("salt", "wrapped_key").head()
    if first is None:
        raise ValueError("no encrypted entries")
    return unwrap_key(encrypted.sparkSession, bytes(first["wrapped_key"]), passphrase, bytes(first["salt"]))


def rewrap(encrypted: DataFrame, passphrase: str, new_passphrase: str) -> DataFrame:
    """The same entries under another passphrase."""
    salt = os.urandom(SALT_SIZE)
    wrapped = wrap_key(encrypted.sparkSession, _data_key(encrypted, passphrase), new_passphrase, salt)
    return encrypted.withColumns({"salt": F.lit(bytearray(salt)), "wrapped_key": F.lit(bytearray(wrapped))})


def decrypt_dictionary(encrypted: DataFrame, passphrase: str) -> DataFrame:
    """The dictionary again.

    ValueError if the passphrase is wrong; a damaged row fails the job that reads it.
    """
    key = key_column(encrypted.sparkSession, _data_key(encrypted, passphrase))
    plain = decrypt_col(F.col("secret"), key).cast("string")
    whole = F.coalesce(plain, F.raise_error(F.lit("decryption failed: corrupted data")).cast("string"))
    fields = F.from_json(whole, "original string, kind string, scope string")
    return encrypted.withColumn("_f", fields).select(
        "token", "prefix", "seq", "_f.original", "_f.kind", "_f.scope", "n_docs"
    )


def stored_maps(spark: SparkSession, path: str, count: int = 5) -> DataFrame:
    """The newest stored maps by name: size in bytes, and whether they are encrypted."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.substring_index("path", "/", -1)
    return (
        found.select(name.alias("name"), F.col("length").alias("bytes"))
        .where(F.col("name").rlike(r"\.(?:json|ghost)$"))
        .withColumn("encrypted", F.col("name").endswith(".ghost"))
        .orderBy(F.desc("name"))
        .limit(count)
    )
