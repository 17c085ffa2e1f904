"""Paths, extensions, kinds of files and how they are shown."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestack.functions.text import lower_simple

# --- fixed values: file types of the query language --------------------------
TYPE_EXTENSIONS = {
    "video": "3g2 3gp avi flv m4v mkv mov mp4 mpeg mpg ogv rm rmvb ts vob webm wmv",
    "music": "aac amr ape flac m4a mid midi mp3 oga ogg opus wav wma",
    "image": "arw bmp cr2 dng gif heic heif ico jpeg jpg nef png raw svg tif tiff webp",
    "doc": "azw3 csv djvu doc docx epub md mobi pdf ppt pptx rtf txt wps xls xlsx",
    "apk": "apk apkm xapk",
}
# categories of the result list, the first that fits
CATEGORIES = [
    ("Word", "doc docx html md txt wps"),
    ("Excel", "csv xls xlsx"),
    ("PPT", "ppt pptx"),
    ("Video", "3gp avi flv m4v mkv mov mp4 ts webm wmv"),
    ("Audio", "aac ape flac m4a mid mp3 ogg wav wma"),
    ("Image", "bmp gif heic heif jpeg jpg png svg webp"),
    ("Doc", "pdf xml"),
]
PARSED_HERE = ["docx", "pptx", "xlsx", "pdf"]
PARSED_OLD = ["doc", "ppt", "xls", "wps"]
MAX_FILE_BYTES = 20_971_520
PRUNED_ANYWHERE = ["LOST.DIR", "lost+found", "proc", "sys", "dev"]
MIME = [
    ("pdf", "application/pdf"),
    ("docx", "application/vnd.openxmlformats-officedocument.wordprocessingml.document"),
    ("doc", "application/msword"),
    ("xlsx", "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet"),
    ("xls", "application/vnd.ms-excel"),
    ("pptx", "application/vnd.openxmlformats-officedocument.presentationml.presentation"),
    ("ppt", "application/vnd.ms-powerpoint"),
    ("txt", "text/plain"),
]
# -----------------------------------------------------------------------------


def base_name(path: Column) -> Column:
    """What follows the last slash; all of it without one."""
    return F.substring_index(path, "/", -1)


def ext_of(path: Column) -> Column:
    """``.ext`` of the last segment in lower case, or empty; a dotfile is all extension."""
    return lower_simple(F.regexp_extract(path, r"[.][^./]*$", 0))


def parent_of(path: Column) -> Column:
    """The folder: ``.`` without a slash, ``/`` for what lies in the root."""
    at = F.length(path) - F.length(base_name(path))  # 1-based place of the last slash
    return F.when(at == 0, F.lit(".")).when(at == 1, F.lit("/")).otherwise(F.left(path, at - 1))


def _choose(ext: Column, table: list[tuple[str, list[str]]], default: Column) -> Column:
    out = default
    for name, exts in reversed(table):
        out = F.when(ext.isin(exts), F.lit(name)).otherwise(out)
    return out


def file_type(path: Column) -> Column:
    """Type in the query language; ``file`` for an unlisted extension."""
    return _choose(ext_of(path), [(t, [f".{e}" for e in x.split()]) for t, x in TYPE_EXTENSIONS.items()], F.lit("file"))


def category(path: Column) -> Column:
    """Category of the result list, by what follows the last dot of the whole path."""
    ext = F.when(F.instr(path, ".") > 0, lower_simple(F.substring_index(path, ".", -1))).otherwise(F.lit(""))
    return _choose(ext, [(c, x.split()) for c, x in CATEGORIES], F.lit("ALL"))


def mime_type(path: Column) -> Column:
    return _choose(F.regexp_replace(ext_of(path), r"^\.", ""), [(m, x.split()) for x, m in MIME], F.lit("*/*"))


def matches_types(kind: Column, path: Column, types: list[str]) -> Column:
    """Any of the types; folders never match, ``file`` matches every file."""
    if not types:
        return F.lit(True)
    wanted = F.lit(True) if "file" in types else file_type(path).isin(types)
    return (kind != "folder") & wanted


def matches_dirs(path: Column, dirs: list[str]) -> Column:
    """All of the texts lie in the lowered folder path."""
    parent = lower_simple(parent_of(path))
    return reduce(lambda a, b: a & b, [F.contains(parent, lower_simple(F.lit(d))) for d in dirs], F.lit(True))


def is_kept(path: Column, root: Column, folder: Column) -> Column:
    """Whether a scan of ``root`` would list the path.

    Hidden folders, system folders and ``data`` and ``obb`` below ``Android`` are
    left out with all they hold, and so are hidden files; the root itself never.
    """
    inside = F.substring(path, F.length(F.regexp_replace(root, "/+$", "")) + 1, F.length(path))
    inside = F.concat(inside, F.when(folder, F.lit("/")).otherwise(F.lit("")))
    named = "|".join(n.replace(".", "[.]").replace("+", "[+]") for n in PRUNED_ANYWHERE)
    root_is_android = base_name(F.regexp_replace(root, "/+$", "")) == "Android"
    pruned = inside.rlike(rf"(^|/)([.][^/]*|{named})/|(^|/)Android/(data|obb)/")
    pruned = pruned | (root_is_android & inside.rlike(r"^/?(data|obb)/"))
    hidden = ~folder & base_name(path).startswith(".")
    return (path == F.regexp_replace(root, "/+$", "")) | ~(pruned | hidden)


def parse_kind(path: Column, size: Column) -> Column:
    """Who extracts the text of a file: ``here``, ``plugin`` or ``none`` (by extension and size)."""
    ext = F.regexp_replace(ext_of(path), r"^\.", "")
    who = F.when(ext.isin(PARSED_HERE), F.lit("here")).when(ext.isin(PARSED_OLD), F.lit("plugin")).otherwise(F.lit("none"))
    return F.when(size.between(1, MAX_FILE_BYTES), who).otherwise(F.lit("none"))


def valid_external(path: Column, root: Column) -> Column:
    """A path of an external feed: below its root, on one line, no ``.`` or ``..`` segments.

    An empty root accepts every path.
    """
    base = F.regexp_replace(root, "/+$", "")
    rest = F.when(root == "", path).otherwise(F.substring(path, F.length(base) + 1, F.length(path)))
    below = (root == "") | (path == base) | path.startswith(F.concat(base, F.lit("/")))
    dots = F.exists(F.split(rest, "/"), lambda x: x.isin(".", ".."))
    return (path != "") & ~path.rlike(r"[\r\n]") & below & ~dots


def size_text(size: Column) -> Column:
    """Bytes, or KB, MB, GB with one decimal; blank for nothing."""
    out = F.when(size > 0, F.concat(size.cast("string"), F.lit(" B"))).otherwise(F.lit(""))
    for unit, power in (("KB", 10), ("MB", 20), ("GB", 30)):
        tenths = F.floor(size * 10 / F.lit(1 << power) + F.lit(0.5)).cast("bigint")
        out = F.when(size >= (1 << power), F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit(f" {unit}"))).otherwise(out)
    return out


def time_text(mtime_ms: Column) -> Column:
    """``yyyy-MM-dd HH:mm`` in the session's zone; blank for no time."""
    return F.when(mtime_ms > 0, F.date_format(F.timestamp_millis(mtime_ms), "yyyy-MM-dd HH:mm")).otherwise(F.lit(""))


def uri_to_path(uri: Column, storage: str) -> Column:
    """A tree document id (``primary:rel``) as a path; null for another volume."""
    rel = F.substring_index(uri, ":", -1)
    return F.when(uri.startswith("primary:"), F.concat_ws("/", F.lit(storage.rstrip("/")), F.nullif(rel, F.lit(""))))


def version_key(version: Column) -> Column:
    """``v1.2.3-beta4`` as an array that sorts like the version; null if it isn't one.

    One to three numbers, then alpha, beta, rc (1, 2, 3) with its number, or 4
    and 0 for a release.
    """
    v = F.trim(version)
    pattern = r"^[vV]?(\d{1,9}(?:\.\d{1,9}){0,2})(?:-(?:(alpha|beta|rc)(.*))?)?$"
    numbers = F.split(F.regexp_extract(v, pattern, 1), "[.]")
    stage, nth = F.regexp_extract(v, pattern, 2), F.regexp_extract(v, pattern, 3)
    at = lambda k: F.coalesce(F.try_element_at(numbers, F.lit(k)).cast("int"), F.lit(0))
    step = F.when(stage == "alpha", 1).when(stage == "beta", 2).when(stage == "rc", 3).otherwise(4)
    count = F.when(nth.rlike(r"^\d{1,9}$"), nth.cast("int")).otherwise(F.lit(0))
    return F.when(v.rlike(pattern), F.array(at(1), at(2), at(3), step, count))
