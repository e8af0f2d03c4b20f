"""Content classification, path policy, archives and extraction."""

from __future__ import annotations

import bz2
import gzip
import io
import struct
import tarfile
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.bytespace import col
from lodestone.shared import byte_batches

CHECK_BYTES = 8192
# Budgets of archive expansion.
BUDGET = {"depth": 3, "entries": 4096, "entry_bytes": 64 << 20, "archive_bytes": 256 << 20, "root_bytes": 512 << 20, "metadata_bytes": 16 << 20, "ratio": 128, "path_bytes": 1024}
# Names of directories and files by kind, and extensions of sources.
TEST_DIRS = ("test", "tests", "__tests__", "spec", "specs", "fixture", "fixtures", "__fixtures__")
VENDOR_DIRS = ("vendor", "third_party", "third-party", "thirdparty", "deps", "external", "extern", "node_modules")
GENERATED_DIRS = ("generated", "gen", "autogen", "auto", "build", "dist", "out", "target", "bazel-bin", "bazel-out", "buck-out")
LOCK_FILES = (
    "berksfile.lock", "bun.lockb", "cargo.lock", "cartfile.resolved", "deno.lock", "flake.lock", "gemfile.lock", "go.sum", "gradle.lockfile", "mix.lock",
    "package.resolved", "pdm.lock", "pnpm-lock.yaml", "podfile.lock", "poetry.lock", "pubspec.lock", "uv.lock",
)
SOURCE_EXT = (
    "bash", "c", "cc", "cfg", "clj", "conf", "cpp", "cs", "css", "dart", "fs", "go", "gradle", "groovy", "h", "hpp", "htm", "html", "ini", "java", "js", "json", "jsx", "kt",
    "less", "lua", "m", "md", "mm", "php", "proto", "ps1", "py", "rb", "rs", "scala", "scss", "sh", "sql", "swift", "toml", "ts", "tsx", "txt", "xml", "yaml", "yml", "zsh",
)
#: This library's own policy: extensions whose files are not scanned as text.  A parameter of path_class and scannable.
BINARY_EXT = (
    "png", "jpg", "jpeg", "gif", "bmp", "ico", "webp", "mp3", "mp4", "avi", "mov", "mkv", "wav", "flac", "ttf", "otf", "woff", "woff2", "eot", "pdf", "psd",
    "exe", "dll", "so", "dylib", "a", "o", "obj", "class", "pyc", "wasm", "bin", "iso", "dmg",
)
PATH_BITS = {"source": 1, "test": 2, "vendor": 4, "generated": 8, "binary": 16, "unknown": 32, "lock_file": 64}


def basename(path: Column | str) -> Column:
    return F.lower(F.regexp_extract(col(path), r"[^/\\]*\z", 0))


def extension(path: Column | str) -> Column:
    return F.regexp_extract(basename(path), r"^.+\.([^.]+)\z", 1)


def is_binary(raw: Column, check: int = CHECK_BYTES) -> Column:
    """A NUL among the first bytes of a Latin-1 column."""
    return F.instr(F.substring(raw, 1, check), "\u0000") > 0


def extractable(path: Column | str) -> Column:
    """The format that is extracted from this path, or null."""
    ext = extension(path)
    return (
        F.when(basename(path).rlike(r"^\.env(?:\..*)?\z"), "dotenv").when(ext == "ipynb", "ipynb").when(ext == "class", "class")
        .when(ext.isin("jar", "war"), "jar").when(ext == "pyc", "pyc")
    )


def classify(path: Column | str, raw: Column) -> Column:
    """'text', 'binary' or 'extract:<format>'; dotenv and notebooks are extracted from text too."""
    form = extractable(path)
    extract = F.concat(F.lit("extract:"), form)
    return F.when(is_binary(raw), F.when(form.isNotNull(), extract).otherwise("binary")).otherwise(F.when(form.isin("dotenv", "ipynb"), extract).otherwise("text"))


def archive_kind(path: Column | str, magic: Column | None = None, tar: Column | None = None) -> Column:
    """By name first, then by the first bytes (hex), then by the five from byte 257 on."""
    name = basename(path)
    out = (
        F.when(name.rlike(r"\.(?:tar\.gz|tgz)\z"), "tar.gz").when(name.rlike(r"\.(?:tar\.bz2|tbz2?)\z"), "tar.bz2").when(name.rlike(r"\.tar\z"), "tar")
        .when(name.rlike(r"\.zip\z"), "zip").when(name.rlike(r"\.gz\z"), "gzip").when(name.rlike(r"\.bz2\z"), "bzip2")
    )
    if magic is not None:
        head = F.upper(F.substring(magic, 1, 8))
        out = out.when(head.startswith("1F8B"), "gzip").when(head.startswith("504B0304") | head.startswith("504B0506"), "zip").when(head.startswith("425A68"), "bzip2")
        if tar is not None:
            out = out.when(F.upper(tar) == "7573746172", "tar")
    return out


def path_class(path: Column | str, binary_ext: tuple[str, ...] = BINARY_EXT) -> Column:
    """Bit set of PATH_BITS: segments between slashes in any case; lock files are no sources; unknown is no other bit."""
    parts = F.split(F.lower(col(path)), "/")
    has = lambda names: F.arrays_overlap(parts, F.array(*[F.lit(n) for n in names]))
    name = F.element_at(parts, -1)
    ext, lock = F.regexp_extract(name, r"^.+\.([^.]+)\z", 1), name.isin(*LOCK_FILES)
    bit = lambda cond, key: F.when(cond, PATH_BITS[key]).otherwise(0)
    known = (
        bit(ext.isin(*SOURCE_EXT) & ~lock, "source") + bit(has(TEST_DIRS), "test") + bit(has(VENDOR_DIRS), "vendor") + bit(has(GENERATED_DIRS), "generated")
        + bit(ext.isin(*binary_ext), "binary") + bit(lock, "lock_file")
    )
    return F.when(known == 0, PATH_BITS["unknown"]).otherwise(known)


def scannable(path: Column | str, binary_ext: tuple[str, ...] = BINARY_EXT) -> Column:
    return path_class(path, binary_ext).bitwiseAND(PATH_BITS["binary"] | PATH_BITS["lock_file"]) == 0


def virtual_path(parent: Column, entry: Column, most: int = BUDGET["path_bytes"]) -> Column:
    """parent::entry with clean separators; too long ones are cut and end in a hash of the whole."""
    clean = F.regexp_replace(F.regexp_replace(F.replace(entry, F.lit("\\"), F.lit("/")), r"(?:^|/)(?:\.{1,2}/)+", "/"), "^/+", "")
    full = F.concat(parent, F.lit("::"), clean)
    return F.when(F.octet_length(full) <= most, full).otherwise(F.concat(F.substring(full, F.lit(1), F.lit(most - 18)), F.lit("~#"), F.substring(F.sha2(full, 256), 1, 16)))


# -- extraction in Arrow batches ------------------------------------------------------------------


def dotenv_lines(text: str) -> str:
    """KEY=VALUE lines of a .env file: export prefixes, quotes, escapes, comments, values over several lines."""
    out, lines, i = [], text.split("\n"), 0
    while i < len(lines):
        line = lines[i].strip().removeprefix("export ").lstrip()
        i += 1
        key, sep, value = line.partition("=")
        key, value = key.strip(), value.lstrip()
        if not sep or line.startswith("#") or not key or not (key[0].isalpha() or key[0] == "_") or not all(c.isalnum() or c in "_.-" for c in key):
            continue
        quote = value[:1]
        if quote in ("'", '"') and quote:
            body, more = value[1:], 0
            while _closing(body, quote) < 0 and i < len(lines) and more < 64:
                body, i, more = body + "\n" + lines[i], i + 1, more + 1
            end = _closing(body, quote)
            body = body[:end] if end >= 0 else body
            if quote == '"':
                for a, b in (("\\n", "\n"), ("\\t", "\t"), ('\\"', '"'), ("\\\\", "\\")):
                    body = body.replace(a, b)
            value = body
        else:
            value = value.split(" #", 1)[0].rstrip()
        out.append(f"{key}={value}")
    return "\n".join(out)


def _closing(body: str, quote: str) -> int:
    at = body.find(quote)
    while at > 0 and quote == '"' and body[at - 1] == "\\":
        at = body.find(quote, at + 1)
    return at


def class_strings(data: bytes) -> list[str]:
    """UTF-8 constants of a Java class file."""
    out, at = [], 10
    if data[:4] != b"\xca\xfe\xba\xbe":
        return out
    count, i = struct.unpack_from(">H", data, 8)[0], 1
    sizes = {3: 4, 4: 4, 5: 8, 6: 8, 7: 2, 8: 2, 9: 4, 10: 4, 11: 4, 12: 4, 15: 3, 16: 2, 17: 4, 18: 4, 19: 2, 20: 2}
    while i < count and at < len(data):
        tag = data[at]
        at += 1
        if tag == 1:
            n = struct.unpack_from(">H", data, at)[0]
            out.append(data[at + 2 : at + 2 + n].decode("utf-8", "replace"))
            at += 2 + n
        elif tag in sizes:
            at += sizes[tag]
        else:
            break
        i += 2 if tag in (5, 6) else 1
    return out


def pyc_strings(data: bytes) -> list[str]:
    """String constants of a compiled Python file: short and long ASCII and UTF-8 marshal objects."""
    out, at = [], 16
    while at < len(data):
        tag = data[at] & 0x7F
        if tag in (0x7A, 0x5A) and at + 2 <= len(data):
            n, at = data[at + 1], at + 2
        elif tag in (0x61, 0x41, 0x75, 0x73) and at + 5 <= len(data):
            n, at = struct.unpack_from("<I", data, at + 1)[0], at + 5
        else:
            at += 1
            continue
        if n and at + n <= len(data):
            try:
                s = data[at : at + n].decode("utf-8")
            except UnicodeDecodeError:
                continue
            if s.isprintable():
                out.append(s)
                at += n if tag != 0x73 else 0
    return out


def extract_text(form: str, data: bytes) -> str | None:
    import json

    try:
        if form == "dotenv":
            return dotenv_lines(data.decode("utf-8", "replace"))
        if form == "ipynb":
            cells = json.loads(data).get("cells", [])
            return "\n".join("".join(c["source"]) if isinstance(c.get("source"), list) else c.get("source", "") for c in cells if c.get("cell_type") == "code")
        if form == "class":
            return "\n".join(class_strings(data))
        if form == "pyc":
            return "\n".join(pyc_strings(data))
        if form == "jar":
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                return "\n".join(s for n in z.namelist()[: BUDGET["entries"]] if n.endswith(".class") for s in class_strings(z.read(n)))
    except (ValueError, KeyError, AttributeError, struct.error, zipfile.BadZipFile, zlib.error):
        return None
    return None


def extract(objects: DataFrame, path_col: str = "path", content_col: str = "content", carry: tuple[str, ...] = ()) -> DataFrame:
    """path, format, text of extractable objects, and columns to carry along (strings); text is null where the content is broken."""
    picked = objects.select(F.col(path_col).alias("path"), extractable(path_col).alias("format"), F.col(content_col).alias("content"), *carry).where("format is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [extract_text(f, c or b"") for f, c in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), *b.columns[3:]], names=["path", "format", "text", *carry])

    byte_batches(objects.sparkSession)
    return picked.mapInArrow(run, ", ".join(["path string, format string, text string", *[f"{c} string" for c in carry]]))


def _kind(name: str, data: bytes) -> str | None:
    low = name.lower()
    for suffixes, kind in (((".tar.gz", ".tgz"), "tar.gz"), ((".tar.bz2", ".tbz", ".tbz2"), "tar.bz2"), ((".tar",), "tar"), ((".zip",), "zip"), ((".gz",), "gzip"), ((".bz2",), "bzip2")):
        if low.endswith(suffixes):
            return kind
    return "gzip" if data[:2] == b"\x1f\x8b" else "zip" if data[:4] in (b"PK\x03\x04", b"PK\x05\x06") else "bzip2" if data[:3] == b"BZh" else "tar" if data[257:262] == b"ustar" else None


#: Compressed files of unknown size are read in steps: a buffer as large as the limit costs more than most files.
STEP_BYTES = 64 << 10


def _read_up_to(opened: io.BufferedIOBase, most: int) -> bytes:
    """The whole of an opened file, or its first most bytes."""
    parts = []
    while most > 0 and (part := opened.read(min(STEP_BYTES, most))):
        parts.append(part)
        most -= len(part)
    return b"".join(parts)


def _entries(name: str, data: bytes, budget: dict) -> Iterator[tuple[str, bytes | None, str]]:
    kind = _kind(name, data)
    if kind in ("gzip", "bzip2"):
        opened = gzip.open(io.BytesIO(data)) if kind == "gzip" else bz2.open(io.BytesIO(data))
        body = _read_up_to(opened, budget["entry_bytes"] + 1)
        yield name.rsplit("::", 1)[-1].rsplit("/", 1)[-1].rsplit(".", 1)[0], *_checked(body, len(data), budget)
    elif kind == "zip":
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            for info in z.infolist():
                if info.is_dir():
                    continue
                if info.flag_bits & 1:
                    yield info.filename, None, "encrypted"
                elif info.file_size > budget["entry_bytes"]:
                    yield info.filename, None, "entry_too_large"
                else:
                    yield info.filename, *_checked(z.read(info), info.compress_size, budget)
    else:
        mode = {"tar": "r:", "tar.gz": "r:gz", "tar.bz2": "r:bz2"}[kind]
        with tarfile.open(fileobj=io.BytesIO(data), mode=mode) as t:
            for m in t:
                if m.isfile():
                    if m.size > budget["entry_bytes"]:
                        yield m.name, None, "entry_too_large"
                    else:
                        yield m.name, t.extractfile(m).read(), "ok"
                elif not m.isdir():
                    yield m.name, None, "special_entry"


def _checked(body: bytes, packed: int, budget: dict) -> tuple[bytes | None, str]:
    if len(body) > budget["entry_bytes"]:
        return None, "entry_too_large"
    if packed and len(body) > (1 << 20) and len(body) / packed > budget["ratio"]:
        return None, "ratio"
    return body, "ok"


def expand_one(path: str, data: bytes, budget: dict, depth: int = 0, root: list[int] | None = None) -> Iterator[tuple[str, bytes | None, str]]:
    """Entries of an archive and of archives in it: (virtual path, content, outcome).

    root counts the bytes of all archives in one file; what inner archives
    give counts there too.
    """
    count = total = names = 0
    root = [0] if root is None else root
    try:
        for name, body, outcome in _entries(path, data, budget):
            count, names = count + 1, names + len(name.encode("utf-8", "surrogatepass"))
            total, root[0] = total + len(body or b""), root[0] + len(body or b"")
            over = (
                "too_many_entries" if count > budget["entries"] else "metadata_too_large" if names > budget["metadata_bytes"]
                else "archive_too_large" if total > budget["archive_bytes"] else "root_too_large" if root[0] > budget["root_bytes"]
                else "ratio" if total > (1 << 20) and total > budget["ratio"] * max(1, len(data)) else None
            )
            if over:
                yield path, None, over
                return
            inner = f"{path}::{name}"
            if body is not None and _kind(name, body):
                if depth + 1 >= budget["depth"]:
                    yield inner, None, "too_deep"
                else:
                    yield from expand_one(inner, body, budget, depth + 1, root)
            else:
                yield inner, body, outcome
    except (OSError, EOFError, zipfile.BadZipFile, tarfile.TarError, zlib.error, RuntimeError, NotImplementedError):
        yield path, None, "corrupt"


#: Entries go on in batches of so many rows, or as soon as they hold so many bytes.
OUT_ROWS, OUT_BYTES = 1024, 8 << 20


def of_rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


ENTRIES = pa.schema([("path", pa.string()), ("content", pa.binary()), ("outcome", pa.string())])


def in_batches(rows: Iterator[tuple], schema: pa.Schema, content: int) -> Iterator[pa.RecordBatch]:
    """Rows gathered into batches; content is the place of what counts as their bytes."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[content] or b"")
        if len(held) >= OUT_ROWS or size >= OUT_BYTES:
            yield of_rows(held, schema)
            held, size = [], 0
    if held:
        yield of_rows(held, schema)


def expanded(batches: Iterator[pa.RecordBatch], limits: dict) -> Iterator[pa.RecordBatch]:
    """The entries of batches of (path, content), gathered into batches of their own."""
    rows = (row for b in batches for path, data in zip(b.column(0), b.column(1), strict=True) for row in expand_one(path.as_py(), data.as_py() or b"", limits))
    return in_batches(rows, ENTRIES, 1)


def expand_archives(objects: DataFrame, path_col: str = "path", content_col: str = "content", budget: dict | None = None) -> DataFrame:
    """path, content, outcome of every entry of every archive among the objects, within budget."""
    limits = {**BUDGET, **(budget or {})}
    byte_batches(objects.sparkSession)
    magic = F.hex(F.substring(F.col(content_col), 1, 4))
    picked = objects.where(archive_kind(path_col, magic, F.hex(F.substring(F.col(content_col), 258, 5))).isNotNull()).select(F.col(path_col).alias("path"), F.col(content_col).alias("content"))
    return picked.mapInArrow(lambda batches: expanded(batches, limits), "path string, content binary, outcome string")


def outcome_counts(entries: DataFrame) -> DataFrame:
    return entries.groupBy("outcome").agg(F.count("*").alias("n"))
