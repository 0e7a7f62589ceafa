"""Labels, formats and classes of values, as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names and markers that results must be equal in.
JUNK_NAMES = (".DS_Store", "Thumbs.db", "desktop.ini")
OWN_DIR = ".stratapool"  # the settings directory; another one is given by the caller
SKIPPED_DIRS = (".Trash", ".Trashes", ".Spotlight-V100", ".fseventsd")
RATE_LIMIT_MARKS = ("429", "ratelimit", "rate limit", "too many requests", "userratelimitexceeded", "ratelimitexceeded")
QUOTA_MARKS = ("quota", "storagelimitexceeded", "storage limit", "insufficient storage", "not enough space", "disk full", "no space left", "enospc", "413", "over quota", "account full")
ERRNO_MARKS = (("not empty", "ENOTEMPTY"), ("is a directory", "EISDIR"), ("not a directory", "ENOTDIR"), ("no space", "ENOSPC"), ("read-only", "EROFS"), ("invalid argument", "EINVAL"), ("name too long", "ENAMETOOLONG"))
FILE_CLASSES = (
    ("video", ("mkv", "mp4", "avi", "mov", "wmv", "m4v", "ts", "webm")),
    ("audio", ("mp3", "flac", "aac", "m4a", "wav", "ogg", "opus")),
    ("image", ("jpg", "jpeg", "png", "gif", "webp", "heic", "bmp", "svg", "ico")),
    ("archive", ("zip", "rar", "7z", "tar", "gz", "bz2", "xz", "zst")),
    ("pdf", ("pdf",)),
    ("office", ("doc", "docx", "xls", "xlsx", "ppt", "pptx", "odt", "ods")),
    ("code", ("py", "go", "js", "ts", "html", "css", "sh", "rb", "java", "c", "cpp", "h", "rs", "swift", "json", "yaml", "yml", "toml", "xml", "sql", "md")),
    ("disk", ("iso", "dmg", "img")),
)
PREVIEWED = ("jpg", "jpeg", "png", "gif", "webp", "bmp", "svg", "ico")
HANDSHAKE_GUID = "258EAFA5-E914-47DA-95CA-C5AB0DC85B11"  # RFC 6455


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _cases(pairs: list[tuple[Column, Column]], otherwise: Column) -> Column:
    out = F.when(*pairs[0])
    for p in pairs[1:]:
        out = out.when(*p)
    return out.otherwise(otherwise)


def _tenths(x: Column, unit: str) -> Column:
    return F.concat(F.call_function("format_number", x, F.lit("0.0")), F.lit(f" {unit}"))


def size_text(b: Column | str) -> Column:
    """B, KB, MB, GB with one decimal."""
    b = _col(b)
    k = F.lit(1024.0)
    return _cases([(b < 1 << 10, F.concat(b.cast("string"), F.lit(" B"))), (b < 1 << 20, _tenths(b / k, "KB")), (b < 1 << 30, _tenths(b / (k * 1024), "MB"))], _tenths(b / (k * 1024 * 1024), "GB"))


def size_text_binary(b: Column | str) -> Column:
    """B, KiB up to EiB with one decimal."""
    b = _col(b)
    pairs = [(b < 1 << 10, F.concat(b.cast("string"), F.lit(" B")))]
    for i, unit in enumerate(("KiB", "MiB", "GiB", "TiB", "PiB"), 1):
        pairs.append((b < 1 << 10 * (i + 1), _tenths(b / F.lit(float(1 << 10 * i)), unit)))
    return _cases(pairs, _tenths(b / F.lit(float(1 << 60)), "EiB"))


def size_text_web(b: Column | str) -> Column:
    """Like size_text, up to TB, halves rounded up; a dash for null or negative."""
    b = _col(b)
    up = lambda x, u: F.concat(F.format_string("%.1f", F.floor(x * 10 + 0.5) / 10), F.lit(f" {u}"))
    return _cases(
        [(b.isNull() | (b < 0), F.lit("—")), (b >= 1 << 40, up(b / float(1 << 40), "TB")), (b >= 1 << 30, up(b / float(1 << 30), "GB")), (b >= 1 << 20, up(b / float(1 << 20), "MB")), (b >= 1 << 10, up(b / 1024.0, "KB"))],
        F.concat(b.cast("string"), F.lit(" B")),
    )


def _ago(n: Column, unit: str) -> Column:
    return F.concat(n.cast("string"), F.lit(f"{unit} ago"))


def age_text(ts: Column | str, now: int, days: int = 30, form: str = "MMM dd, yyyy") -> Column:
    ts = _col(ts)
    d = F.lit(now) - ts
    whole = lambda s: F.floor(d / s)
    return _cases([(ts == 0, F.lit("-")), (d < 60, F.lit("just now")), (d < 3600, _ago(whole(60), "m")), (d < 86400, _ago(whole(3600), "h")), (d < days * 86400, _ago(whole(86400), "d"))], F.date_format(F.timestamp_seconds(ts), form))


def duration_text(seconds: Column | str) -> Column:
    s = F.floor(_col(seconds)).cast("long")
    d, h, m = F.floor(s / 86400), F.floor(s / 3600) % 24, F.floor(s / 60) % 60
    text = lambda *xs: F.concat(*[y for x, u in xs for y in (x.cast("long").cast("string"), F.lit(u))])
    return _cases([(d > 0, text((d, "d "), (h, "h "), (m, "m"))), (h > 0, text((h, "h "), (m, "m"))), (m > 0, text((m, "m "), (s % 60, "s")))], text((s, "s")))


def uptime_text(seconds: Column | str) -> Column:
    s = F.floor(_col(seconds)).cast("long")
    text = lambda *xs: F.concat(*[y for x, u in xs for y in (x.cast("long").cast("string"), F.lit(u))])
    return _cases([(s < 60, text((s, "s"))), (s < 3600, text((F.floor(s / 60), "m "), (s % 60, "s")))], text((F.floor(s / 3600), "h "), (F.floor(s % 3600 / 60), "m")))


def state_label(state: Column | str) -> Column:
    s = _col(state)
    return _cases([(s == "stub", F.lit("cloud")), (s == "uploading", F.lit("uploading…"))], s)


def is_junk(name: Column | str) -> Column:
    n = _col(name)
    return n.isin(*JUNK_NAMES) | n.startswith("._")


def is_skipped(name: Column | str, own: str = OWN_DIR) -> Column:
    """Junk, the settings directory, and temporary files beside it."""
    n = _col(name)
    return is_junk(n) | (n == own) | n.startswith(own + "-")


def is_skipped_dir(name: Column | str, own: str = OWN_DIR) -> Column:
    return _col(name).isin(own, *SKIPPED_DIRS)


def extension(name: Column | str) -> Column:
    return F.lower(F.substring_index(_col(name), ".", -1))


def file_class(name: Column | str, is_dir: Column | None = None) -> Column:
    """The first class that knows the extension."""
    e = extension(name)
    pairs = [(e.isin(*x), F.lit(c)) for c, x in FILE_CLASSES]
    return _cases(([(is_dir, F.lit("directory"))] if is_dir is not None else []) + pairs, F.lit("other"))


def is_previewed(name: Column | str) -> Column:
    return extension(name).isin(*PREVIEWED)


def html_escape(s: Column | str) -> Column:
    return reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")), _col(s))


def _has_any(message: Column, marks: tuple[str, ...]) -> Column:
    low = F.lower(message)
    return F.coalesce(reduce(lambda a, b: a | b, [F.contains(low, F.lit(m)) for m in marks]), F.lit(False))


def is_rate_limited(message: Column | str) -> Column:
    return _has_any(_col(message), RATE_LIMIT_MARKS)


def is_quota_exceeded(message: Column | str) -> Column:
    return _has_any(_col(message), QUOTA_MARKS)


def errno(message: Column | str) -> Column:
    m = _col(message)
    known = (("file does not exist", "ENOENT"), ("file already exists", "EEXIST"), ("permission denied", "EACCES"), *ERRNO_MARKS)
    return _cases([(m.isNull(), F.lit("OK")), *[(F.contains(m, F.lit(k)), F.lit(v)) for k, v in known]], F.lit("EIO"))


def ensure_colon(remote: Column | str) -> Column:
    return F.concat(F.regexp_replace(_col(remote), ":$", ""), F.lit(":"))


def backoff_seconds(attempt: Column | str, rate_limited: Column, uniform: Column) -> Column:
    """2^attempt seconds, three times that when rate-limited, at most 30, and up to half as much again by ``uniform``."""
    b = F.least(F.pow(F.lit(2.0), _col(attempt)) * F.when(rate_limited, 3.0).otherwise(1.0), F.lit(30.0))
    return b + uniform * b / 2


def mask_key(key: Column | str) -> Column:
    k = _col(key)
    return F.when(F.length(k) <= 8, k).otherwise(F.concat(F.left(k, F.lit(4)), F.lit("..."), F.right(k, F.lit(4))))


def provider_detail(identity: Column | str, kind: Column | str) -> Column:
    both = F.concat_ws(", ", F.nullif(_col(identity), F.lit("")), F.nullif(_col(kind), F.lit("")))
    return F.when(both == "", F.lit("")).otherwise(F.concat(F.lit("("), both, F.lit(")")))


def plural(n: Column | str) -> Column:
    return F.when(_col(n) == 1, F.lit("")).otherwise(F.lit("s"))


def data_and_parity(text: Column | str) -> Column:
    """struct(data, parity) of a text such as 3+2; null if it has another form."""
    part = lambda i: F.regexp_extract(_col(text), r"^(\d+)\+(\d+)", i).try_cast("int")
    return F.struct(part(1).alias("data"), part(2).alias("parity"))


def parse_remotes(text: Column | str) -> Column:
    return F.filter(F.transform(F.split(_col(text), ","), lambda x: F.trim(x)), lambda x: x != "")


def identity_from_json(kind: Column | str, body: Column | str) -> Column:
    """An account's name from its provider's answer."""
    k, b = _col(kind), _col(body)
    at = lambda p: F.coalesce(F.get_json_object(b, p), F.lit(""))
    return _cases(
        [(k == "drive", at("$.user.emailAddress")), (k == "dropbox", at("$.email")), (k == "onedrive", F.coalesce(F.nullif(at("$.mail"), F.lit("")), at("$.userPrincipalName"))), (k == "box", at("$.login"))],
        F.lit(""),
    )


def access_token(config: Column | str) -> Column:
    """The token in a settings document, which is JSON in a JSON string."""
    return F.coalesce(F.get_json_object(F.get_json_object(_col(config), "$.token"), "$.access_token"), F.lit(""))


def remote_path(directory: str, chunk_id: Column | str, shard: Column | str, shards: Column | str) -> Column:
    name = F.concat(F.lit(directory + "/"), _col(chunk_id))
    return F.when(_col(shards) > 1, F.concat(name, F.lit(".s"), _col(shard).cast("string"))).otherwise(name)


def under_directory(directory: str, path: Column | str) -> Column:
    """A listed path, with its directory in front where that is missing."""
    p = _col(path)
    return F.when(p.startswith(directory + "/"), p).otherwise(F.concat(F.lit(directory + "/"), p))


def rename_key(sha: Column | str, size: Column | str) -> Column:
    return F.concat(_col(sha), F.lit(":"), _col(size).cast("string"))


def handshake_accept(key: Column | str) -> Column:
    return F.base64(F.unhex(F.sha1(F.concat(_col(key), F.lit(HANDSHAKE_GUID)))))


def rfc3339(text: Column | str) -> Column:
    """Unix seconds of a listed modification time; null where it can't be read."""
    return F.unix_timestamp(F.try_to_timestamp(_col(text)))


def frame_header(length: Column | str) -> Column:
    """The length bytes of an unmasked text frame, in hexadecimal: 7, 7+16 or 7+64 bits."""
    n = _col(length)
    digits = lambda k: F.lpad(F.hex(n), k, "0")
    return F.concat(F.lit("81"), _cases([(n < 126, digits(2)), (n < 1 << 16, F.concat(F.lit("7E"), digits(4)))], F.concat(F.lit("7F"), digits(16))))
