"""Files that were not written by hand in their repository: generated, minified, data, vendored.

1. An inverted index of line hashes (hashes of three consecutive lines, blank and trivial lines left out) finds copies from
   other repositories. Each hash names one file of its first and one of its last repository (in the order of their codes),
   so every file gets a partner in another repository without any pairs within a hash; a file's rarest hashes weigh most
   in the choice. The partner is verified by exact containment. Files whose partner fails are counted against all files
   of other repositories: files that share the same of their hashes are one, and a file that holds enough of another one
   must hold one of its rarest hashes, so that only those make pairs.
2. For the rest, rules over the composition of a file: its tokens by kind (names, literals and their characters, numbered
   definitions, line lengths), the marks of its leading comment, lock files, record dumps, and directories that hold
   third-party code.
3. A library's own files, in the repository of its name, are no copies.

Null contents and null paths give no case; an empty file is none. Repeated rows count once per file key. A hash that a
third of all files share costs one row per file and no pair, unless it is among the rarest of a file whose partner fails.
Fewer than ``LEAST_HASHES`` hashes are no evidence of a copy.
"""

from __future__ import annotations

import hashlib
import io
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sorrel.plans.runtime import cut, is_empty, spread

SHARED = 0.6  # of a file's line hashes in other repositories
CONTAINED = 0.5  # of a file's line hashes in its partner
LEAST_HASHES = 5

VENDOR_DIR = re.compile(r"(?:^|/)(?:node_modules|third[_-]?party|vendor|vendored|_vendor|bower_components|site-packages|external_libs|jspm_packages)/|(?:^|/)(?:deps|externals?|contrib)/[\w.-]+[_-]v?\d+(?:\.\d+)+/")
VENDOR_NAME = re.compile(r"(?:^|/)(?:node_modules|vendor|vendored|_vendor|bower_components|site-packages)/(?:@[\w-]+/)?([\w-]+)/|(?:^|/)deps/([\w]+?)[_-]v?\d+(?:\.\d+)+/|(?:^|/)third[_-]?party/(?:[\w-]+/)*?([\w-]+)/[^/]+$")
PART_OF = re.compile(r"\b(?:part of|[Cc]opied from|[Vv]endored from|[Tt]aken from|[Ff]orked from)\s+([\w-]+)\s+v?\d+(?:\.\d+)+|\b[Cc]opied from ([\w-]+)[ ,]")
COPIED = re.compile(r"\b(?:copied|vendored|taken verbatim|forked|imported) from\s+([\w.-]+)\s+v?\d", re.I)
# fixed values: what tools write into the files they make
GENERATED = re.compile(
    r"@generated\b|\bauto-?\s?generated\b|\b(?:automatically|machine)[ -](?:written|generated|made)\b|\bgenerated automatically\b|\bdo not (?:edit|modify)\b|"
    r"\bproduced by\b.*\b(?:do not|don't)\b|\boutput, regenerate with\b|\bregenerate with\b|\bchanges will be (?:lost|overwritten)\b|\bwritten by the \w+ tool\b|\bautomatisch (?:erzeugt|generiert)\b|"
    r"\bgenerad[oa] autom[aá]ticamente\b|\bgénéré automatiquement\b|自动生成|\block ?file\b.*\bdo not\b", re.I)
# says little by itself: a version, a file, a command or a tool's name in capitals must stand beside it
MADE = re.compile(r"\bgenerated (?:by|from|with|using)\b[^\n]*?(?:\bv?\d+(?:\.\d+)+|\b[\w-]+\.[a-z]\w{1,8}\b|`[^`\n]+`|\b\w+[-_/]\w+)", re.I)
LOCK_NAME = re.compile(r"(?:^|/)(?:package-lock\.json|npm-shrinkwrap\.json|shrinkwrap\.json|yarn\.lock|pnpm-lock\.ya?ml|poetry\.lock|pipfile\.lock|cargo\.lock|composer\.lock|gemfile\.lock|uv\.lock|pdm\.lock|[\w.-]+\.lock)$", re.I)
MIN_NAME = re.compile(r"[.-](?:min|bundle|chunk|packed)\.(?:js|mjs|cjs)$|\.[0-9a-f]{8,}\.(?:js|mjs)$|_pb2(?:_grpc)?\.py$", re.I)
BUILT = re.compile(r"[.-](?:min|bundle|chunk)\.")
NUMBERED = re.compile(r"^\s*(?:async\s+)?(?:def|class|function|static|const|let|var)?\s*[A-Za-z_]\w*?_?(\d+)\s*(?:\(|=|:)", re.M)
DEFINED = re.compile(r"^\s*(?:async\s+)?(?:def|class|function)\s+(\w+)", re.M)
LITERAL = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|-?\b\d[\w.]*")
NAME = re.compile(r"[A-Za-z_$][\w$]*")
JSON_PART = re.compile(r"\"(?:[^\"\\]|\\.)*\"(?=(\s*:)?)|[{}\[\]]", re.S)
COMMENT = re.compile(r"^\s*(?:#|//|/\*|\*|<!--|;)")


def leading_comment(content: str) -> str:
    """Comment lines before the first line of code."""
    out = []
    block = False
    for line in io.StringIO(content.lstrip("﻿")):
        s = line.strip()
        if not s or s in ("'use strict';", '"use strict";'):
            continue
        if block or COMMENT.match(line):
            out.append(s)
            if s.startswith("/*"):
                block = True
            if "*/" in s:
                block = False
            continue
        break
    return "\n".join(out)


def _top_key(content: str, key: str) -> bool:
    """Whether a JSON object, also one that is cut off, has the key at its top."""
    depth = 0
    for m in JSON_PART.finditer(content):
        if m.group(0) == key and depth == 1 and m.group(1):
            return True
        depth += (m.group(0) in "{[") - (m.group(0) in "}]")
    return False


def _lock(path: str, content: str) -> bool:
    if LOCK_NAME.search(path):
        return True
    if path.endswith(".json"):
        return '"lockfileVersion"' in content and _top_key(content, '"lockfileVersion"') or content.count('"integrity"') >= 3
    if path.endswith(".toml"):
        blocks = content.count("[[package]]")
        return blocks >= 3 and len(re.findall(r"^(?:hash|checksum|sha256|integrity)\s*=", content, re.M)) >= 0.6 * blocks
    return False


def _numbered(content: str) -> bool:
    """Definitions named by a running number."""
    defs = DEFINED.findall(content)
    if len(defs) < 3:
        return False
    marked = [d for d in defs if re.search(r"_?\d+$", d)]
    return len(marked) >= 0.8 * len(defs) and len({re.sub(r"^.*?(\d+)$", r"\1", d) for d in marked}) >= 2


def _tokens(path: str, content: str) -> dict[str, int]:
    """Tokens of the code by kind, comments left out; a docstring is an empty literal unless it holds hardly any words."""
    code = re.sub(r"^\s*(?:#|//).*$", "", content, flags=re.M)
    if path.endswith(".py"):
        code = re.sub(r'("""|\'\'\')[\s\S]*?\1', lambda m: '""' if m.group(0).count(" ") > len(m.group(0)) / 12 else m.group(0), code)
    literals = LITERAL.findall(code)
    sizes = list(map(len, literals))
    return {"names": len(NAME.findall(LITERAL.sub("", code))), "literals": len(literals), "literal_chars": sum(sizes), "longest_literal": max(sizes, default=0), "solid": len(re.sub(r"\s", "", code))}


def _lines(content: str) -> dict[str, int]:
    lines = [x for x in content.split("\n") if x.strip() and not x.lstrip().startswith(("//", "/*"))]
    return {"lines": len(lines), "body": sum(map(len, lines)), "longest_line": max(map(len, lines), default=0), "blanks": sum(x.count(" ") for x in lines)}


def _records(content: str) -> bool:
    """A JSON array (or lines) of many objects with equal keys, or of many rows of numbers."""
    s = content.strip()
    if not s.startswith(("[", "{")):
        return False
    import json

    def same(rows: list) -> bool:
        if len(rows) < 8:
            return False
        if all(isinstance(r, dict) for r in rows):
            kinds = {tuple(sorted(r)) for r in rows}
            return len(kinds) <= max(1, len(rows) // 8)
        return len(rows) >= 20 and all(isinstance(r, (list, int, float)) for r in rows)

    try:
        v = json.loads(s)
    except ValueError:
        rows = []
        for line in s.split("\n"):
            try:
                rows.append(json.loads(line))
            except ValueError:
                break
        if len(rows) >= 8 and all(isinstance(r, dict) for r in rows) and same(rows):
            return True
        # not valid as a whole (cut off): equal keys again and again, from the first bracket on
        keys = re.findall(r"\{\s*\"(\w+)\"\s*:", s)
        return s.startswith("[") and len(keys) >= 8 and len(set(keys)) == 1
    except RecursionError:
        return False
    if isinstance(v, list):
        return same(v)
    # one key that holds (nearly) everything
    big = [x for x in v.values() if isinstance(x, list) and same(x) and len(x) >= 20]
    return bool(big) and len(v) <= 3 and all(isinstance(r, dict) and "id" in r or isinstance(r, list) for r in big[0])


def library(path: str, head: str) -> str | None:
    """The library that the leading comment or the directory names."""
    m = PART_OF.search(head)
    if m:
        return m.group(1) or m.group(2)
    m = VENDOR_NAME.search(path)
    return next((g for g in m.groups() if g), None) if m else None


FLAGS = ("blank", "vendor_dir", "names_library", "copied", "made", "lock", "built_name", "numbered", "records")
COUNTS = ("names", "literals", "literal_chars", "longest_literal", "solid", "lines", "body", "longest_line", "blanks")


def composition(path: str, content: str) -> dict:
    """What the rules look at, of one file."""
    out: dict = dict.fromkeys(FLAGS, False) | dict.fromkeys(COUNTS, 0) | {"library": None}
    if not content.strip():
        return out | {"blank": True}
    head = leading_comment(content)
    out |= {
        "library": library(path, head), "vendor_dir": bool(VENDOR_DIR.search(path)), "names_library": bool(PART_OF.search(head)), "copied": bool(COPIED.search(head)),
        "made": bool(GENERATED.search(head) or MADE.search(head)), "lock": _lock(path, content), "built_name": bool(MIN_NAME.search(path)),
    }
    script = path.endswith((".js", ".mjs", ".cjs"))
    if path.endswith(".json"):
        out["records"] = _records(content)
    elif script or path.endswith(".py"):
        out |= _tokens(path, content)
    if path.endswith(".py"):
        out["numbered"] = _numbered(content)
    if script:
        out |= _lines(content)
    return out


def ruled(rest: DataFrame) -> DataFrame:
    """file_key, reason (vendored, generated, minified, data) of files by their composition alone."""
    c = lambda name: F.col("of")[name]
    foreign = c("library").isNull() | F.col("repo_name").isNull() | (c("library") != F.col("repo_name"))
    small_space = c("blanks") < 0.12 * c("body")
    minified = small_space & (((c("longest_line") >= 400) & (2 * c("longest_line") >= c("body"))) | (c("body") > 180 * c("lines")))
    mass, n, names = c("literal_chars") / F.greatest(c("solid"), F.lit(1)), c("literals"), c("names")
    data = ((n >= 40) & (mass > 0.5) & (names < 0.12 * n)) | ((n >= 8) & (c("solid") >= 300) & (mass > 0.8) & (names < 0.3 * n)) | ((c("longest_literal") > 800) & (mass > 0.85) & (names < 40))
    reason = (
        F.when(c("blank"), F.lit(None).cast("string"))
        .when((c("vendor_dir") | c("copied") | (c("names_library") & c("library").isNotNull())) & foreign, "vendored")
        .when(c("made") | c("built_name") | c("lock"), F.when(c("built"), "minified").otherwise("generated"))
        .when(c("numbered"), "generated").when((c("lines") > 0) & minified, "minified").when(c("records") | data, "data")
    )
    return rest.withColumn("reason", reason).where("reason is not null").select("file_key", "reason")


def line_hashes(content: str) -> list[int]:
    """Distinct hashes of three consecutive lines that say something, in order."""
    lines = [s for s in (x.strip() for x in content.split("\n")) if len(s) >= 4 and not s.startswith(("import ", "from "))]
    found = {"\n".join(w) for w in zip(lines, lines[1:], lines[2:])}
    return sorted(int.from_bytes(hashlib.blake2b(w.encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True) for w in found)


SCHEMA = "struct<" + ",".join(f"{f}:boolean" for f in (*FLAGS, "built")) + "," + ",".join(f"{c}:int" for c in COUNTS) + ",library:string>"


def examined(files: DataFrame) -> DataFrame:
    """file_key, repo_name, library, of (the composition), hashes of each row."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kind = pa.struct([*((f, pa.bool_()) for f in (*FLAGS, "built")), *((c, pa.int32()) for c in COUNTS), ("library", pa.string())])
        for batch in batches:
            keys, repos, paths, contents = (batch.column(k).to_pylist() for k in range(4))
            parts = [composition(p, c) | {"built": bool(BUILT.search(p))} for p, c in zip(paths, contents)]
            yield pa.record_batch(
                [pa.array(keys, pa.string()), pa.array(repos, pa.string()), pa.array([x["library"] for x in parts], pa.string()), pa.array(parts, kind), pa.array([line_hashes(c) for c in contents], pa.list_(pa.int64()))],
                names=["file_key", "repo_name", "library", "of", "hashes"])

    return spread(files.where("content is not null and path is not null").select("file_key", "repo_name", "path", "content")).mapInArrow(run, f"file_key string, repo_name string, library string, of {SCHEMA}, hashes array<long>")


def _repository_seed(seen: DataFrame) -> int:
    """A seed with which no two repositories have one code."""
    names, seed = cut(seen.select("repo").distinct()), 0
    while not is_empty(names.groupBy(F.xxhash64("repo", F.lit(seed))).count().where("count > 1")):
        seed += 1
    return seed


def shared_hashes(seen: DataFrame) -> DataFrame:
    """file_key, size, shared: the hashes of each distinct row, and those that another repository has, too."""
    rows = cut(seen.select("file_key", F.coalesce("repo_name", F.lit("")).alias("repo"), "hashes").distinct().withColumn("file", F.monotonically_increasing_id()))
    post = rows.select("file", "repo", F.explode("hashes").alias("h"))
    both = post.groupBy("h").agg((F.min("repo") < F.max("repo")).alias("several")).where("several").select("h")
    n = post.join(both, "h").groupBy("file").agg(F.count("*").alias("shared"))
    return rows.join(n, "file", "left").select("file_key", F.size("hashes").alias("size"), F.coalesce("shared", F.lit(0)).alias("shared"))


def copies(seen: DataFrame) -> DataFrame:
    """file_key, partner, contained: files held by a file of another repository. ``seen``: file_key, repo_name, library, hashes.

    Distinct rows of one key are judged each; equal rows are one."""
    rows = cut(seen.select("file_key", F.coalesce("repo_name", F.lit("")).alias("repo"), "library", "hashes").distinct().withColumn("file", F.monotonically_increasing_id()))
    seed = _repository_seed(rows)
    coded = rows.select("file", F.xxhash64("repo", F.lit(seed)).alias("origin"), "library", "hashes")
    post = coded.select("file", "origin", "library", F.explode("hashes").alias("h"))
    place = F.struct("origin", "file")
    index = post.groupBy("h").agg(F.min(place).alias("lo"), F.max(place).alias("hi"), F.count("*").alias("df"), F.max("library").alias("lib")).where("lo.origin <> hi.origin")
    hits = post.select("file", "origin", "h").join(index, "h").select("file", "df", F.coalesce("lib", F.lit("")).alias("lib"), F.when(F.col("lo.origin") != F.col("origin"), F.col("lo.file")).otherwise(F.col("hi.file")).alias("partner"))
    # pre-aggregated by file and partner; a file's rarest hashes weigh most in the choice of its partner
    by = hits.groupBy("file", "partner", "lib").agg(F.count("*").alias("n"), F.sum(1 / F.col("df")).alias("w"))
    top = by.groupBy("file").agg(F.sum("n").alias("shared"), F.max_by("partner", F.struct("w", "partner")).alias("partner"), F.max_by("lib", F.struct("n", "lib")).alias("lib"))
    size = F.size("hashes")
    likely = cut(top.join(rows, "file").where((size >= LEAST_HASHES) & (F.col("shared") >= SHARED * size) & (F.col("lib") != F.col("repo"))).select("file", "file_key", "hashes", "partner"))
    theirs = rows.select(F.col("file").alias("partner"), F.col("file_key").alias("partner_key"), F.col("hashes").alias("held"))
    share = F.size(F.array_intersect("hashes", "held")) / size
    tried = cut(likely.join(theirs, "partner").select("file", "file_key", size.alias("size"), F.col("partner_key").alias("partner"), share.alias("contained")))
    held = tried.where(F.col("contained") >= CONTAINED).select("file_key", "partner", "contained")
    failed = tried.where(F.col("contained") < CONTAINED).select("file", "size")
    if is_empty(failed):
        return held
    names = rows.select("file", "file_key")
    other = elsewhere(cut(post.select("file", "origin", "h")), failed)
    other = other.join(names, "file").join(names.select(F.col("file").alias("partner"), F.col("file_key").alias("partner_key")), "partner")
    return held.unionAll(other.select("file_key", F.col("partner_key").alias("partner"), "contained"))


def elsewhere(post: DataFrame, failed: DataFrame) -> DataFrame:
    """file, partner, contained of those of the failed files that any file of another repository holds."""
    near = cut(post.join(post.join(failed, "file", "left_semi").select("h").distinct(), "h", "left_semi").select("file", "origin", "h"))
    # files with the same of these hashes are one set, named by one of them
    signed = near.groupBy("file", "origin").agg(F.count("*").alias("c"), F.bit_xor("h").alias("x"), F.bit_xor(F.xxhash64("h")).alias("y"))
    place = F.struct("origin", "file")
    sets = cut(signed.groupBy("c", "x", "y").agg(F.min(place).alias("lo"), F.max(place).alias("hi"), F.min("file").alias("set")))
    hashes = cut(near.join(sets.select(F.col("set").alias("file")), "file", "left_semi").select(F.col("file").alias("set"), "h"))
    others = hashes.withColumnRenamed("set", "other")
    asked = cut(signed.join(failed, "file").join(sets, ["c", "x", "y"]).select("file", "origin", "size", "set"))
    wanted = asked.select("set", "origin", "size").distinct()
    # all but the last need - 1 hashes, rarest first: who holds enough holds one of them
    rank = F.row_number().over(W.partitionBy("set").orderBy("df", "h"))
    rare = hashes.join(wanted.select("set", "size").distinct(), "set").join(hashes.groupBy("h").agg(F.count("*").alias("df")), "h").withColumn("rank", rank).where(F.col("rank") <= F.col("size") - F.ceil(CONTAINED * F.col("size")) + 1)
    partner = F.when(F.col("lo.origin") != F.col("origin"), F.col("lo.file")).when(F.col("hi.origin") != F.col("origin"), F.col("hi.file"))
    pairs = rare.select("set", "h").join(others, "h").select("set", "other").distinct().join(wanted, "set").join(sets.select(F.col("set").alias("other"), "lo", "hi"), "other").withColumn("partner", partner).where("partner is not null")
    counted = pairs.select("set", "origin", "size", "other", "partner").join(hashes, "set").join(others, ["other", "h"]).groupBy("set", "origin", "size", "partner").agg(F.count("*").alias("n")).where(F.col("n") >= CONTAINED * F.col("size"))
    best = counted.groupBy("set", "origin").agg(F.max(F.struct("n", "partner")).alias("best"))
    return asked.join(best, ["set", "origin"]).select("file", F.col("best.partner").alias("partner"), (F.col("best.n") / F.col("size")).alias("contained"))


def foreign_files(files: DataFrame) -> DataFrame:
    """file_key, reason of each file that was not written by hand in its repository (one row per key).

    The index comes first; the rules see what it leaves."""
    seen = cut(examined(files))
    own = seen.where(F.col("library") == F.col("repo_name")).select("file_key")
    copied = cut(copies(seen).select("file_key").distinct().join(own, "file_key", "left_anti"))
    left = ruled(seen.select("file_key", "repo_name", "of").join(copied, "file_key", "left_anti"))
    return copied.withColumn("reason", F.lit("vendored")).unionAll(left.groupBy("file_key").agg(F.min("reason").alias("reason")))
