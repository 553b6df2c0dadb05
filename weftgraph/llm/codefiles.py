"""Files among the code that nobody wrote by hand.

One automaton holds all literal patterns of paths: directory names and file-name endings.
A second one holds the notices that tools leave in file headers.  A text is read once,
whatever the number of patterns.  A hit counts by its role: names that people also give to
their own folders need a package's folder below them, ordinary words also have to stand
outside of the source tree, and a notice has to stand in a comment.  What literals cannot
say (families of suffixes, version numbers, content hashes, dates) is checked by a few
expressions on the file name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# ---- fixed values ----

#: Directories that package managers fill: everything below is a copy.
INSTALLED = """
node_modules bower_components jspm_packages web_modules site-packages dist-packages .venv venv virtualenv carthage
.cargo/registry go/pkg/mod .gem/ruby .m2/repository .yarn/cache .pnpm
""".split()
#: Directories that people keep copies of packages in; the package is a folder below.
VENDORED = "vendor vendors vendored _vendor third_party third-party thirdparty 3rdparty 3rd_party pods".split()
#: Ordinary words that mean the same, but only beside the source tree, not in it.
OUTSIDE = "external externals extern deps".split()
#: Directories of a source tree.
SOURCE_TREE = "src app lib internal pkg cmd core services server client tests test".split()
#: Directories that tools write into.
GENERATED = """
generated __generated__ generated-sources generated_sources generated-src gen-src gen_src src-gen autogen auto-generated auto_generated
gen-py gen-go gen-java gen-js gen-cpp gen-rb gen-php gen-csharp gen-nodejs
""".split()
#: Directories of bundles.
BUNDLED = "dist".split()
#: Endings of generated files (of the base name, lower case).
GENERATED_ENDINGS = """
grpc.java outerclass.java .designer.cs .freezed.dart openapi-client.ts openapi-client.js openapi_client.py .graphql.ts _string.go .tab.c .yy.c
""".split()
#: Endings of minified or bundled files.
MINIFIED_ENDINGS = "-min.js -min.css _min.js .packed.js .pack.js .uglified.js .uglify.js".split()
#: Lock files.
LOCK_FILES = """
package-lock.json yarn.lock pnpm-lock.yaml npm-shrinkwrap.json cargo.lock poetry.lock pipfile.lock gemfile.lock composer.lock go.sum
""".split()
#: Languages that say a file holds data, whatever its suffix.
DATA_LANGS = "csv tsv json jsonl text txt xml yaml yml toml binary data".split()
#: Notices, lower case, that count anywhere in a comment of the header.
NOTICES = [
    "do not edit", "do not modify", "@generated", "code generated by", "code generated from", "automatically generated", "auto-generated", "autogenerated",
    "this file is generated", "this file was generated", "file generated by", "file generated with", "this is a generated file", "machine generated", "machine-generated",
    "generated by the protocol buffer compiler",
]
#: Notices that count where a comment begins with them.
OPENINGS = ["generated by", "generated from", "generated with", "produced by"]
#: Libraries that are copied as single files.
LIBRARIES = "jquery bootstrap lodash underscore backbone moment angular handlebars mustache modernizr knockout mootools zepto tinymce ckeditor codemirror mathjax leaflet".split()

_SOURCE = r"\.(?:py|js|mjs|cjs|ts|tsx|jsx|go|rs|java|rb|c|cc|cpp|h|hpp|cs|php|kt|swift|scala|dart)$"
#: Families of file names.
BY_NAME = [
    ("generated", r"\.pb(?:\.[a-z]+)?\.[a-z]+$"),
    ("generated", r"_pb(?:2(?:_grpc)?)?\.(?:pyi?|js|d\.ts|rb|ts)$"),
    ("generated", r"(?:^zz_|[._])gen(?:erated)?(?:\.[a-z0-9_]+)?" + _SOURCE),
    ("generated", r"\.g" + _SOURCE),
    ("generated", r"^mock_[a-z0-9_]+\.go$"),
    ("minified", r"\.(?:min|bundle|chunk)(?:\.[0-9a-f]+)?\.(?:js|mjs|css|jsx|ts)$"),
    ("minified", r"[.\-_](?=[a-f]*[0-9])[0-9a-f]{8,40}(?:\.[a-z]+)?\.(?:js|mjs|css)$"),
    ("minified", r"\.(?:umd|prod|production|iife|esm)(?:\.[a-z]+)*\.m?js$"),
    ("vendored", r"-v?\d+(?:\.\d+)+(?:\.[a-z]+)?\.(?:js|mjs|css)$"),
    ("vendored", r"^(?:" + "|".join(LIBRARIES) + r")(?:[.\-](?:slim|core|all|full|compat|v?\d[\w.]*))*\.(?:js|css)$"),
    ("data", r"(?:_b64|_base64(?:_[a-z0-9]+)?|_hexdump|_bindata)(?:_\d+)*" + _SOURCE),
    ("data", r"(?:_blob|_lut|_lut_data|_dataset|_dump|_bytes|_table)(?:_\d+)+" + _SOURCE),
    ("data", r"[a-z0-9_\-]\.(?:json|csv|xml|data|txt|bin)\.(?:js|ts|py|rb|go)$"),
]
#: Families of paths.
BY_PATH = [
    ("generated", r"/migrations/\d{4}_auto_\d{8}_\d{4}\.py$"),
    ("generated", r"/target/(?:debug|release)/build/[^/]+/out/[^/]+$"),
    ("vendored", r"/[^/]+@v\d+\.\d+[^/]*/"),
    ("data", r"/(?:data|assets|fixtures|resources|static|testdata|tables)/(?:.*/)?[^/]*(?:_blob|_lut|_lut_data|_dataset|_dump|_bytes)" + _SOURCE),
]
#: What a line of a comment begins with.
COMMENT = r"^\s*(?:#|//|/\*|\*|--|;|<!--|%|\"\"\"|''')[\s#/*\-;!%]*"

# ---- end of fixed values ----

_NAMES = [(why, re.compile(p.removesuffix("$") + r"\Z" if p.endswith("$") else p)) for why, p in BY_NAME]
_PATHS = [(why, re.compile(p.removesuffix("$") + r"\Z" if p.endswith("$") else p)) for why, p in BY_PATH]
_DATA_FILE = re.compile(_SOURCE.removesuffix("$") + r"\Z")
_TREE = re.compile("/(?:" + "|".join(SOURCE_TREE) + ")/")
_COMMENT = re.compile(COMMENT)


def path_automaton() -> ahocorasick.Automaton:
    """All literals of paths (``/dir/``, and an ending with an end mark), with reason and role."""
    found = ahocorasick.Automaton()
    for names, why, role in ((INSTALLED, "vendored", "any"), (VENDORED, "vendored", "package"), (OUTSIDE, "vendored", "outside"), (GENERATED, "generated", "any"), (BUNDLED, "minified", "any")):
        for n in names:
            found.add_word(f"/{n}/", (why, role))
    for ends, why in ((GENERATED_ENDINGS, "generated"), (MINIFIED_ENDINGS, "minified")):
        for e in ends:
            found.add_word(f"{e}\n", (why, "any"))
    for e in LOCK_FILES:
        found.add_word(f"/{e}\n", ("generated", "any"))
    found.make_automaton()
    return found


def notice_automaton() -> ahocorasick.Automaton:
    """All notices, with whether they have to open their comment."""
    found = ahocorasick.Automaton()
    for n in OPENINGS:
        found.add_word(n, (n, True))
    for n in NOTICES:
        found.add_word(n, (n, False))
    found.make_automaton()
    return found


def classify(path: str | None, lang: str | None, paths: ahocorasick.Automaton) -> str | None:
    """``vendored``, ``generated``, ``minified`` or ``data`` for a file nobody wrote by hand, else None.

    Case and the kind of separator make no difference.  A null or empty path says nothing.
    """
    if not path:
        return None
    p = "/" + "/".join(s for s in path.lower().replace("\\", "/").split("/") if s not in ("", "."))
    for end, (why, role) in paths.iter(p + "\n"):
        if role == "any" or ("/" in p[end + 1 :] and (role == "package" or not _TREE.search(p[: p.rindex("/", 0, end) + 1]))):
            return why
    name = p.rpartition("/")[2]
    for why, pattern in _NAMES:
        if pattern.search(name):
            return why
    for why, pattern in _PATHS:
        if pattern.search(p):
            return why
    if lang is not None and lang.strip().lower() in DATA_LANGS and _DATA_FILE.search(name):
        return "data"
    return None


def has_notice(head: str | None, notices: ahocorasick.Automaton) -> bool:
    """Whether a comment of a file's beginning says that a tool wrote the file.  The whole text given is read."""
    if not head:
        return False
    low = head.lower()
    if len(low) != len(head):  # some letters grow
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in head)
    for end, (notice, opens) in notices.iter(low):
        at = end + 1 - len(notice)
        line = low[low.rfind("\n", 0, at) + 1 : at]
        mark = _COMMENT.match(line)
        if mark and (not opens or mark.end() == len(line)):
            return True
    return False


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    paths = path_automaton()
    for batch in batches:
        ids, path, lang = (c.to_pylist() for c in batch.columns)
        why = [classify(p, g, paths) for p, g in zip(path, lang)]
        keep = [k for k, w in enumerate(why) if w]
        yield pa.RecordBatch.from_arrays([pa.array([ids[k] for k in keep], pa.int64()), pa.array([why[k] for k in keep], pa.string())], names=["artifact_id", "reason"])


def _noticed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    notices = notice_automaton()
    for batch in batches:
        ids = [i for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if has_notice(t, notices)]
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64())], names=["artifact_id"])


def not_hand_written(artifacts: DataFrame, heads: DataFrame | None = None) -> DataFrame:
    """``artifact_id, reason`` of the code artifacts nobody wrote by hand, one row each.

    Artifacts are code if ``kind`` says so (case and outer blanks disregarded).  ``heads``
    (``artifact_id, text``) has the beginnings of files, where they are known; they are
    searched where they lie, and only the ids of those with a notice leave the scan.
    Versions and repeats of an artifact give one row, with the alphabetically first reason
    of its paths, or ``notice`` if only its header tells.  Rows without id say nothing.
    """
    code = artifacts.where((F.lower(F.trim("kind")) == "code") & F.col("id").isNotNull()).select(F.col("id").cast("long").alias("artifact_id"), "path", "lang").distinct()
    judged = code.mapInArrow(_judge, "artifact_id long, reason string").groupBy("artifact_id").agg(F.min("reason").alias("reason"))
    if heads is None:
        return judged
    told = heads.where("artifact_id is not null and text is not null").select(F.col("artifact_id").cast("long"), "text").mapInArrow(_noticed, "artifact_id long").distinct()
    more = told.join(code.select("artifact_id").distinct(), "artifact_id", "left_semi").withColumn("reason", F.lit("~notice"))
    every = judged.unionByName(more).groupBy("artifact_id").agg(F.min("reason").alias("reason"))
    return every.withColumn("reason", F.translate("reason", "~", ""))  # the mark puts it behind the others
