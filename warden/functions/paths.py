"""Storage path functions. All are column expressions without Python UDFs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Schemes and the Azure blob host suffix.
S3, ABFS, SAS, HTTPS = "s3://", "abfs://", "sas://", "https://"
BLOB_HOST = ".blob.core.windows.net"

# scheme://authority/path, without query and fragment
_URL = r"\A[A-Za-z0-9+.\-]+://([^/?#]*)/?([^?#]*)"


def _starts(path: Column, scheme: str) -> Column:
    return F.startswith(path, F.lit(scheme))


def _rest(path: Column, scheme: str) -> Column:
    return F.substr(path, F.lit(len(scheme) + 1))


def java_split_trim(text: Column, separator: str) -> Column:
    """Split on a one-character separator, dropping trailing empty parts.

    A text of separators only has no parts; an empty text has one empty part.
    """
    trimmed = F.regexp_replace(text, f"{separator}+\\z", "")
    return F.when((trimmed == "") & (text != ""), F.array().cast("array<string>")).otherwise(
        F.split(trimmed, separator)
    )


def to_storage_path(path: Column) -> Column:
    """``sas://x`` -> ``s3://x``; other paths stay as they are."""
    return F.when(_starts(path, SAS), F.concat(F.lit(S3), _rest(path, SAS))).otherwise(path)


def to_sas_path(path: Column) -> Column:
    """Storage path -> ``sas://``. The original scheme is not kept."""
    return (
        F.when(_starts(path, S3), F.concat(F.lit(SAS), _rest(path, S3)))
        .when(_starts(path, ABFS), F.concat(F.lit(SAS), _rest(path, ABFS)))
        .when(
            _starts(path, HTTPS) & F.contains(path, F.lit(BLOB_HOST)),
            F.concat(F.lit(SAS), _rest(path, HTTPS)),
        )
        .otherwise(path)
    )


def _before(text: Column, mark: str) -> Column:
    at = F.instr(text, mark)
    return F.when(at > 1, F.substring(text, F.lit(1), at - 1)).otherwise(text)


def _after_first_slash(text: Column) -> Column:
    at = F.instr(text, "/")
    inside = (at > 1) & (at < F.length(text))
    return F.when(inside, F.substr(text, at + 1)).otherwise(F.lit(""))


def bucket(path: Column) -> Column:
    """Bucket or container; NULL for other schemes."""
    actual = to_storage_path(normalize(path))
    return F.when(_starts(actual, S3), _before(_rest(actual, S3), "/")).when(
        _starts(actual, ABFS), _before(_rest(actual, ABFS), "@")
    )


def key(path: Column) -> Column:
    """Object key or blob name; the path itself for other schemes."""
    actual = to_storage_path(normalize(path))
    return (
        F.when(_starts(actual, S3), _after_first_slash(_rest(actual, S3)))
        .when(_starts(actual, ABFS), _after_first_slash(_rest(actual, ABFS)))
        .otherwise(path)
    )


def is_directory(path: Column) -> Column:
    return F.endswith(path, F.lit("/"))


def normalize(path: Column) -> Column:
    """Collapse repeated slashes (not after a colon) and drop one trailing slash."""
    collapsed = F.regexp_replace(path, "(?<!:)//+", "/")
    trailing = (F.length(collapsed) > 1) & F.endswith(collapsed, F.lit("/"))
    return F.when(trailing, F.substring(collapsed, F.lit(1), F.length(collapsed) - 1)).otherwise(collapsed)


def data_format(name: Column) -> Column:
    """Format label from a reader class name, format name or file name."""
    lower = F.lower(name)
    chain = F.when(F.contains(lower, F.lit("parquet")), F.lit("parquet"))
    for label in ("delta", "json", "csv"):
        chain = chain.when(F.contains(lower, F.lit(label)), F.lit(label))
    return chain.otherwise(F.lit("unknown"))


def path_namespace(path: Column) -> Column:
    """Namespace a path belongs to: NULL when an s3 or abfs path has none, "" elsewhere."""
    s3_parts = F.split(_rest(path, S3), "/")
    abfs_parts = F.split(path, "/")
    return (
        F.when(_starts(path, S3), F.get(s3_parts, F.lit(1)))
        .when(F.contains(path, F.lit(ABFS)), F.get(abfs_parts, F.lit(3)))
        .otherwise(F.lit(""))
    )


def provider(path: Column) -> Column:
    """Storage provider; NULL when the path is not supported."""
    return F.when(_starts(path, S3), F.lit("s3")).when(
        _starts(path, ABFS) | _starts(path, HTTPS), F.lit("azure")
    )


def provider_error(path: Column) -> Column:
    return F.when(provider(path).isNull(), F.concat(F.lit("unsupported storage path: "), path))


def object_reference(path: Column) -> Column:
    """``STRUCT<account, container, object, error>`` a grant points to."""
    authority = F.regexp_extract(path, _URL, 1)
    object_name = F.regexp_extract(path, _URL, 2)
    at_parts = F.split(authority, "@")
    https_parts = F.split(object_name, "/")
    https_rest = F.array_join(F.slice(https_parts, 2, F.greatest(F.size(https_parts) - 1, F.lit(0))), "/")

    is_s3, is_abfs, is_https = (_starts(path, s) for s in (S3, ABFS, HTTPS))
    bad_abfs = is_abfs & (F.size(at_parts) != 2)
    none = F.lit(None).cast("string")
    return F.struct(
        F.when(is_abfs & ~bad_abfs, F.substring_index(F.get(at_parts, F.lit(1)), ".", 1))
        .when(is_https, F.substring_index(authority, ".", 1))
        .otherwise(none)
        .alias("account"),
        F.when(is_s3, F.regexp_replace(authority, r"\A.*@", ""))
        .when(is_abfs & ~bad_abfs, F.get(at_parts, F.lit(0)))
        .when(is_https, F.get(https_parts, F.lit(0)))
        .otherwise(none)
        .alias("container"),
        F.when(is_s3 | (is_abfs & ~bad_abfs), object_name)
        .when(is_https, F.when(F.size(https_parts) > 1, https_rest).otherwise(F.lit("")))
        .otherwise(none)
        .alias("object"),
        F.coalesce(
            provider_error(path), F.when(bad_abfs, F.lit("invalid ABFS host format"))
        ).alias("error"),
    )


def blob_url(account: Column, container: Column, blob: Column) -> Column:
    return F.format_string("https://%s.blob.core.windows.net/%s/%s", account, container, blob)


def grant_permissions(provider_name: Column, operation: Column) -> Column:
    """Permission names a grant carries on each provider."""
    azure = provider_name == "azure"
    return (
        F.when(operation == "read", F.array(F.lit("read")))
        .when((operation == "write") & azure, F.array(F.lit("write"), F.lit("create")))
        .when(operation == "write", F.array(F.lit("put")))
        .when(operation == "delete", F.array(F.lit("delete")))
    )
