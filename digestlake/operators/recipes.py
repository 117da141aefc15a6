"""Recipes: a container as references to blobs that others hold, and the literal bytes between; minted, checked, rebuilt.

Every reference is compared with the container's bytes before
it is kept, so that a wrong one is never emitted, and a rebuilt container must have its digest.
"""

import base64
import gzip
import hashlib
import io
import json
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from digestlake.functions.digests import IDENTITY_FLOOR
from digestlake.operators.grouped import on_whole_groups
from digestlake.operators.intervals import INLINE_BYTES
from digestlake.sources import descent

#: Fixed value: gzip levels in the order in which they are tried.
GZIP_LEVELS = (9, 6, 1, 8, 7, 5, 4, 3, 2)


def segments_of(data: bytes, refs: list[tuple[bytes, str]]) -> list[tuple[int, int, str]]:
    """Where the refs (bytes, sha256) lie in data: from the longest on, each at its first place that is free."""
    taken: list[tuple[int, int, str]] = []
    for content, sha256 in sorted(refs, key=lambda r: -len(r[0])):
        at = data.find(content) if content else -1
        while at >= 0:
            if all(at + len(content) <= a or at >= a + n for a, n, _ in taken):
                taken.append((at, len(content), sha256))
                break
            at = data.find(content, at + 1)
    return sorted(taken)


def gzip_node(wrapped: bytes, inner: bytes) -> dict | None:
    """The level and header under which the inner bytes compress to exactly the wrapped ones."""
    header = gzip_header(wrapped)
    for level in GZIP_LEVELS:
        packer = zlib.compressobj(level, zlib.DEFLATED, -15)
        made = wrapped[:header] + packer.compress(inner) + packer.flush() + zlib.crc32(inner).to_bytes(4, "little") + (len(inner) & 0xFFFFFFFF).to_bytes(4, "little")
        if made == wrapped:
            return {"kind": "gzip", "level": level, "header": base64.b64encode(wrapped[:header]).decode()}
    return None


def gzip_header(data: bytes) -> int:
    flags, at = data[3], 10
    if flags & 4:
        at += 2 + int.from_bytes(data[at : at + 2], "little")
    for bit in (8, 16):
        if flags & bit:
            at = data.index(b"\0", at) + 1
    return at + (2 if flags & 2 else 0)


def mint(data: bytes, name: str, claimed: dict[str, str]) -> tuple[dict, bytes]:
    """The recipe of one container, and its residue. claimed: links by the sha256 of content that others hold."""
    sha256 = hashlib.sha256(data).hexdigest()
    if sha256 in claimed:
        return {"kind": "ref", "sha256": sha256, "size": len(data), "url": claimed[sha256]}, b""
    residue = io.BytesIO()
    return node(data, name, claimed, residue, 0), residue.getvalue()


def node(data: bytes, name: str, claimed: dict[str, str], residue: io.BytesIO, depth: int) -> dict:
    kind, base = descent.sniffed(data, name), {"sha256": hashlib.sha256(data).hexdigest(), "size": len(data)}
    if kind == "gzip" and depth < descent.MAX_DEPTH:
        try:
            inner = gzip.decompress(data)
            packed = gzip_node(data, inner)
        except (OSError, EOFError, zlib.error, ValueError, IndexError):
            packed = None
        if packed:
            digest = hashlib.sha256(inner).hexdigest()
            if digest in claimed:
                return base | packed | {"input": {"kind": "ref", "sha256": digest, "size": len(inner), "url": claimed[digest]}}
            return base | packed | {"input": node(inner, descent.unwrapped(name, kind), claimed, residue, depth + 1)}
    refs: list[tuple[bytes, str]] = []
    built: dict[str, tuple[dict, bytes] | None] = {}
    try:
        for member, content in descent.PARSERS[kind](data) if kind in descent.PARSERS else ():
            digest = hashlib.sha256(content).hexdigest()
            if digest not in claimed and digest not in built:
                built[digest] = nested(content, member.rsplit("/", 1)[-1], claimed, depth + 1) if content in data else None
            if digest in claimed or built[digest]:
                refs.append((content, digest))
    except Exception:  # what cannot be read stays literal
        pass
    parts, at = [], 0
    for begin, size, digest in [*segments_of(data, refs), (len(data), 0, "")]:
        if begin > at:
            literal = data[at:begin]
            if len(literal) <= INLINE_BYTES:
                parts.append({"kind": "inline", "data": base64.b64encode(literal).decode()})
            else:
                parts.append({"kind": "residue", "at": residue.tell(), "size": len(literal)})
                residue.write(literal)
        if size and digest not in claimed:
            below, rest = built[digest]
            parts.append(moved(below, residue.tell()))
            residue.write(rest)
        elif size:
            parts.append({"kind": "ref", "sha256": digest, "size": size, "url": claimed[digest]})
        at = begin + size
    return base | {"kind": "splice", "parts": parts}


def nested(content: bytes, name: str, claimed: dict[str, str], depth: int) -> tuple[dict, bytes] | None:
    """The node of an unclaimed member that is a container, and a residue of its own; none if nothing below it is claimed."""
    kind = descent.sniffed(content, name)
    if len(content) < IDENTITY_FLOOR or depth >= descent.MAX_DEPTH or not (kind == "gzip" or kind in descent.PARSERS):
        return None
    residue = io.BytesIO()
    made = node(content, name, claimed, residue, depth)
    return (made, residue.getvalue()) if any(refs_of(made)) else None


def moved(recipe: dict, by: int) -> dict:
    """The recipe with its residue that many bytes further on."""
    if recipe["kind"] == "residue":
        return recipe | {"at": recipe["at"] + by}
    if "input" in recipe:
        return recipe | {"input": moved(recipe["input"], by)}
    return recipe | {"parts": [moved(p, by) for p in recipe["parts"]]} if "parts" in recipe else recipe


def rebuilt(recipe: dict, blobs: dict[str, bytes], residue: bytes) -> bytes:
    """The container, verified node by node; a missing or wrong part is an error."""
    kind = recipe["kind"]
    if recipe.get("sha256") in blobs:
        made = blobs[recipe["sha256"]]
    elif kind == "ref":
        raise KeyError(f"missing {recipe['sha256']}")
    elif kind == "inline":
        return base64.b64decode(recipe["data"])
    elif kind == "residue":
        return residue[recipe["at"] : recipe["at"] + recipe["size"]]
    elif kind == "gzip":
        inner = rebuilt(recipe["input"], blobs, residue)
        packer = zlib.compressobj(recipe["level"], zlib.DEFLATED, -15)
        made = base64.b64decode(recipe["header"]) + packer.compress(inner) + packer.flush() + zlib.crc32(inner).to_bytes(4, "little") + (len(inner) & 0xFFFFFFFF).to_bytes(4, "little")
    else:
        made = b"".join(rebuilt(p, blobs, residue) for p in recipe["parts"])
    if hashlib.sha256(made).hexdigest() != recipe["sha256"]:
        raise ValueError(f"{recipe['sha256']} does not verify")
    return made


def refs_of(recipe: dict) -> Iterator[dict]:
    """All references of a recipe, for a list of what to fetch."""
    if recipe["kind"] == "ref":
        yield recipe
    for below in [*recipe.get("parts", ()), *([recipe["input"]] if "input" in recipe else [])]:
        yield from refs_of(below)


def minted(files: DataFrame, claims: DataFrame) -> DataFrame:
    """path, recipe (JSON), residue, fetchable and left bytes of each container (path, content).

    claims: root, sha256, url of the members that others hold, as the members' walk and the lookup found them.
    """
    held = claims.groupBy("root").agg(F.map_from_entries(F.collect_set(F.struct("sha256", "url"))).alias("claimed"))
    rows = files.join(held, files["path"] == held["root"], "left").select("path", "content", "claimed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content, claimed in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), b.column("claimed").to_pylist(), strict=True):
                recipe, residue = mint(content, path, dict(claimed or {}))
                fetchable = sum(r["size"] for r in refs_of(recipe))
                yield pa.RecordBatch.from_pydict({"path": [path], "recipe": [json.dumps(recipe)], "residue": [residue], "fetchable": [fetchable], "left": [len(residue)]}, schema=pa.schema([("path", pa.string()), ("recipe", pa.string()), ("residue", pa.binary()), ("fetchable", pa.int64()), ("left", pa.int64())]))

    return rows.mapInArrow(run, "path string, recipe string, residue binary, fetchable long, left long")


def git_trees(files: DataFrame) -> DataFrame:
    """root, tree: git's id of each root's files (root, path, blob: hex git id, executable).

    Entries are sorted with directories as if their names ended in a slash; a path that ends in a slash is an empty directory.
    """

    def trees(frame: pd.DataFrame) -> pd.DataFrame:
        made = []
        for root, part in frame.groupby("root", sort=False, dropna=False):
            top: dict = {}
            for path, blob, executable in zip(part["path"], part["blob"], part["executable"], strict=True):
                *above, name = path.split("/")
                at = top
                for step in above:
                    at = at.setdefault(step, {})
                if name:
                    at[name] = (blob, executable)
            made.append((None if pd.isna(root) else root, tree_id(top)))
        return pd.DataFrame(made, columns=["root", "tree"])

    kind = dict(files.dtypes)["root"]
    return on_whole_groups(files, "root", ["path"], trees, f"root {kind}, tree string")


def tree_id(entries: dict) -> str:
    rows = []
    for name, entry in entries.items():
        is_dir = isinstance(entry, dict)
        mode, digest = (b"40000", tree_id(entry)) if is_dir else (b"100755" if entry[1] else b"100644", entry[0])
        rows.append(((name + "/" if is_dir else name).encode(), mode + b" " + name.encode() + b"\0" + bytes.fromhex(digest)))
    body = b"".join(r for _, r in sorted(rows))
    return hashlib.sha1(b"tree %d\0" % len(body) + body).hexdigest()
