"""Literal cases of paths, labels and classes."""

import base64
import hashlib

import pytest
from pyspark.sql import functions as F

from stratapool.functions import paths, text


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column.alias("y")).first().y


@pytest.mark.parametrize(("size", "label"), [(0, "0 B"), (500, "500 B"), (1024, "1.0 KB"), (1536, "1.5 KB"), (1048576, "1.0 MB"), (1073741824, "1.0 GB"), (2147483648, "2.0 GB"), (1 << 45, "32768.0 GB")])
def test_size_text(spark, size, label):
    assert one(spark, size, text.size_text("x"), "long") == label


def test_other_sizes(spark):
    assert one(spark, 1 << 60, text.size_text_binary("x"), "long") == "1.0 EiB"
    assert one(spark, None, text.size_text_web("x"), "long") == "—" and one(spark, -1, text.size_text_web("x"), "long") == "—"
    assert one(spark, 1280, text.size_text_web("x"), "long") == "1.3 KB" and one(spark, 1 << 40, text.size_text_web("x"), "long") == "1.0 TB"


@pytest.mark.parametrize(("name", "junk"), [(".DS_Store", True), ("._something", True), ("Thumbs.db", True), ("desktop.ini", True), ("._", True), ("readme.txt", False), ("photo.jpg", False), (".gitignore", False)])
def test_junk(spark, name, junk):
    assert one(spark, name, text.is_junk("x")) is junk


def test_labels(spark):
    assert one(spark, 200_000.0, text.duration_text("x"), "double") == "2d 7h 33m" and one(spark, 61.0, text.duration_text("x"), "double") == "1m 1s"
    assert one(spark, 0, text.age_text("x", 100), "long") == "-" and one(spark, 1, text.age_text("x", 100), "long") == "1m ago" and one(spark, 86400, text.age_text("x", 10_000_000), "long") == "Jan 02, 1970"
    assert one(spark, "stub", text.state_label("x")) == "cloud" and one(spark, "other", text.state_label("x")) == "other"
    assert one(spark, "a.TS", text.file_class("x")) == "video" and one(spark, "noext", text.file_class("x")) == "other" and one(spark, "x.md", text.file_class("x")) == "code" and one(spark, "d", text.file_class("x", F.lit(True))) == "directory"
    assert one(spark, "p.heic", text.is_previewed("x")) is False and one(spark, "p.heic", text.file_class("x")) == "image"
    assert one(spark, "<a href=\"x\">&", text.html_escape("x")) == "&lt;a href=&quot;x&quot;&gt;&amp;"
    assert one(spark, "HTTP 429 Too Many", text.is_rate_limited("x")) is True and one(spark, None, text.is_rate_limited("x")) is False
    assert one(spark, "ENOSPC here", text.is_quota_exceeded("x")) is True
    assert one(spark, None, text.errno("x")) == "OK" and one(spark, "x is a directory", text.errno("x")) == "EISDIR" and one(spark, "what", text.errno("x")) == "EIO"
    assert one(spark, "a:", text.ensure_colon("x")) == "a:" and one(spark, "a", text.ensure_colon("x")) == "a:"
    assert one(spark, "12345678", text.mask_key("x")) == "12345678" and one(spark, "abcdefghij", text.mask_key("x")) == "abcd...ghij"
    assert one(spark, "3+2", text.data_and_parity("x")) == (3, 2) and one(spark, "no", text.data_and_parity("x")) == (None, None)
    assert one(spark, " a, ,b,", text.parse_remotes("x")) == ["a", "b"]
    assert one(spark, '{"token":"{\\"access_token\\":\\"t\\"}"}', text.access_token("x")) == "t" and one(spark, "{}", text.access_token("x")) == ""
    assert one(spark, "k", text.handshake_accept("x")) == base64.b64encode(hashlib.sha1(("k" + text.HANDSHAKE_GUID).encode()).digest()).decode()
    assert one(spark, 1, text.plural("x"), "int") == "" and one(spark, "", text.provider_detail("x", F.lit(""))) == ""


def test_skipped(spark):
    assert one(spark, ".mine-tmp", text.is_skipped("x", ".mine")) is True and one(spark, "mine", text.is_skipped("x", ".mine")) is False
    assert one(spark, ".Trash", text.is_skipped_dir("x")) is True and one(spark, "docs", text.is_skipped_dir("x")) is False
    assert one(spark, 300, text.frame_header("x"), "int") == "817E012C" and one(spark, 5, text.frame_header("x"), "int") == "8105"
    assert one(spark, "2024-01-01T00:00:00Z", text.rfc3339("x")) == 1704067200 and one(spark, "odd", text.rfc3339("x")) is None


def test_paths(spark):
    assert paths.norm_dir("/a") == paths.norm_dir("/a/") == "/a/" and paths.norm_dir("/") == "/"
    assert paths.clean("a/../../b/./c//d") == "/b/c/d" and paths.clean("") == "/" and paths.clean_mount("../x") == "/../x" and paths.clean_mount("") == "/."
    assert paths.join("/a/", "/b") == "/a/b" and paths.join("/") == "/"
    assert one(spark, "/a/b/c", paths.ancestors("x")) == ["/a", "/a/b", "/a/b/c"] and one(spark, "/", paths.ancestors("x")) == []
    assert one(spark, "/a", paths.parent("x")) == "/" and one(spark, "/a/b", paths.parent("x")) == "/a" and one(spark, "/", paths.base("x")) == "/"
    assert one(spark, "/PHOTOS/x", paths.under("x", "/photos")) is True and one(spark, "/É/x", paths.under("x", "/é")) is False and one(spark, "/PHOTOS/x", paths.under("x", "/photos", True)) is False


@pytest.mark.parametrize(
    ("glob", "name", "hit"),
    [("*.pdf", "a.pdf", True), ("*.pdf", "a.PDF", False), ("a?c", "abc", True), ("a?c", "ac", False), ("[a-c]x", "bx", True), ("[^a-c]x", "bx", False), ("[^a-c]x", "dx", True), ("\\*x", "*x", True), ("\\*x", "ax", False), ("", "any", True), ("[bad", "my[bad", True), ("[bad", "bad", False), ("*100%*", "100%_done.txt", True), ("*_done*", "100%_done.txt", True), ("a.b", "axb", False), ("[]a]", "x[]a]", True), ("x[a", "ax[a", True), ("(a)", "(a)", True)],
)
def test_globs(spark, glob, name, hit):
    assert one(spark, name, paths.glob_matches("x", glob)) is hit
