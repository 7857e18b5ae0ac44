"""Content trees: portable paths and a 16-way Merkle trie over hashed routes."""

from __future__ import annotations

import hashlib
import json
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lazy import pandas

#: Device names that some systems reserve.
RESERVED = ("con", "prn", "aux", "nul", *(f"com{k}" for k in range(1, 10)), *(f"lpt{k}" for k in range(1, 10)))
DEPTH = 64
#: Files of a subtree that one task hashes, and nibbles of the longest prefix.
GROUP, DEEPEST = 4096, 5


def portable(path: str) -> str | None:
    """The NFC form of a relative path that every system can hold, else None."""
    own = unicodedata.normalize("NFC", path)
    if not own or len(own.encode()) > 4096 or own.startswith("/") or "\\" in own:
        return None
    for part in own.split("/"):
        if part in ("", ".", "..") or len(part.encode()) > 255 or part[-1] in ". " or any(ord(c) < 32 or c in '<>:"|?*\x7f' for c in part):
            return None
        if part.split(".")[0].lower() in RESERVED:
            return None
    return own


def alias(path: str) -> str:
    """What systems without letter case would call a path."""
    return unicodedata.normalize("NFC", unicodedata.normalize("NFC", path).casefold())


@pandas("struct<path:string,alias:string>")
def _portable(s: pd.Series) -> pd.DataFrame:
    own = s.map(lambda p: portable(p) if p is not None else None)
    return pd.DataFrame({"path": own, "alias": own.map(lambda p: alias(p) if p is not None else None)})


def portable_paths(paths: DataFrame) -> DataFrame:
    """``(path, portable, alias)``; a null portable path is refused."""
    return paths.withColumn("p", _portable("path")).select("path", F.col("p.path").alias("portable"), "p.alias")


def collisions(paths: DataFrame) -> DataFrame:
    """``alias`` of paths that coincide, or of which one is a folder of another."""
    rows = portable_paths(paths).filter("portable is not null")
    same = rows.groupBy("alias").agg(F.count("*").alias("n")).filter("n > 1").select("alias")
    inner = rows.filter(F.size(F.split("alias", "/")) > 1)
    up = inner.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("alias", "/")) - 1), lambda k: F.array_join(F.slice(F.split("alias", "/"), F.lit(1), k), "/"))).alias("alias"))
    return same.union(rows.join(up.distinct(), "alias", "left_semi").select("alias")).distinct()


def tagged(tag: str, *parts: bytes) -> bytes:
    """SHA-256 with a domain tag and each part's length."""
    h = hashlib.sha256(tag.encode() + b"\0")
    for p in parts:
        h.update(len(p).to_bytes(8, "big") + p)
    return h.digest()


def canonical_json(value) -> bytes:
    return json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":")).encode()


def route(path: str) -> str:
    """A path's route: the nibbles of its hash."""
    return tagged("route", path.encode()).hex()


def leaf(path: str, digest: str) -> bytes:
    return tagged("leaf", path.encode(), bytes.fromhex(digest))


def node(kids: dict[str, bytes]) -> bytes:
    """A branch: its children by nibble."""
    return tagged("node", *(k.encode() + v for k, v in sorted(kids.items())))


EMPTY = tagged("empty")


class Trie:
    """A trie over ``(path, sha256)``: a single entry below a branch is a leaf there."""

    def __init__(self, entries: dict[str, str]) -> None:
        self.entries = entries
        self.routes = sorted((route(p), p) for p in entries)

    def _hash(self, rows: list[tuple[str, str]], depth: int) -> bytes:
        if not rows:
            return EMPTY
        if len(rows) == 1:
            return leaf(rows[0][1], self.entries[rows[0][1]])
        return node({k: self._hash(own, depth + 1) for k, own in self._split(rows, depth).items()})

    @staticmethod
    def _split(rows, depth):
        out: dict[str, list] = {}
        for r in rows:
            out.setdefault(r[0][depth], []).append(r)
        return out

    def root(self) -> str:
        return self._hash(self.routes, 0).hex()

    def prove(self, path: str) -> dict:
        """Siblings along a path's route, and the entry (or none) where it ends."""
        rows, depth, steps, own = self.routes, 0, [], route(path)
        while len(rows) > 1:
            kids = self._split(rows, depth)
            steps.append({k: self._hash(v, depth + 1).hex() for k, v in kids.items() if k != own[depth]})
            rows, depth = kids.get(own[depth], []), depth + 1
        return {"path": path, "steps": steps, "entry": [rows[0][1], self.entries[rows[0][1]]] if rows else None}


def verify_proof(root: str, proof: dict) -> str | None:
    """The digest that a proof shows for its path, None if it shows that there is none; ValueError if it shows nothing."""
    own = route(proof["path"])
    entry = proof["entry"]
    here = leaf(*entry) if entry else None
    for depth in range(len(proof["steps"]) - 1, -1, -1):
        kids = {k: bytes.fromhex(v) for k, v in proof["steps"][depth].items()}
        if own[depth] in kids:
            raise ValueError("a proof names its own branch as a sibling")
        if here is not None:
            kids[own[depth]] = here
        if len(kids) < 2 and not (entry is None and depth == len(proof["steps"]) - 1):
            raise ValueError("a branch with a single child")
        here = node(kids)
    if (here or EMPTY).hex() != root:
        raise ValueError("the proof does not lead to the root")
    if entry and route(entry[0])[: len(proof["steps"])] != own[: len(proof["steps"])]:
        raise ValueError("the proof's entry is not on the route")
    return entry[1] if entry and entry[0] == proof["path"] else None


def roots(files: DataFrame, prefix: int = 2) -> DataFrame:
    """``(route, n, root, only)``: the subtree of each route prefix of ``(path, sha256)``, on the executors.

    With ``prefix`` nibbles there are at most 16 ** prefix rows; :func:`root` folds them.
    """

    @F.pandas_udf("string")
    def routed(s: pd.Series) -> pd.Series:
        return s.map(route)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        trie = Trie(dict(zip(group["path"], group["sha256"])))
        own = group["route"].iloc[0]
        one = group["path"].iloc[0] if len(group) == 1 else None
        return pd.DataFrame({"route": [own], "n": [len(group)], "root": [trie._hash(trie.routes, prefix).hex()], "only": [one]})

    rows = files.select("path", "sha256", F.substring(routed("path"), 1, prefix).alias("route"))
    return rows.groupBy("route").applyInPandas(run, "route string, n long, root string, only string")


def root(files: DataFrame, prefix: int | None = None) -> str:
    """The tree's root hash, equal to :class:`Trie`'s.

    Without a ``prefix`` there are as many subtrees as leave some GROUP files
    to each, 16 ** DEEPEST at most: these, and no files, come to the driver.
    """
    if prefix is None:
        prefix, many = 1, files.count()
        while prefix < DEEPEST and many > GROUP * 16**prefix:
            prefix += 1
    rows = [(r.route, r.n, bytes.fromhex(r.root)) for r in roots(files, prefix).collect()]

    def fold(rows, depth) -> bytes:
        if not rows:
            return EMPTY
        if depth == prefix or len(rows) == 1 and rows[0][1] == 1:
            return rows[0][2]
        kids: dict[str, list] = {}
        for r in rows:
            kids.setdefault(r[0][depth], []).append(r)
        return node({k: fold(v, depth + 1) for k, v in kids.items()})

    return fold(rows, 0).hex()


def entries(files: DataFrame, former: DataFrame | None = None) -> DataFrame:
    """``(path, sha256, entry, reused)``: each file's leaf hash; where ``former`` (these columns) has the same path and
    digest, its entry is taken over."""

    @F.pandas_udf("string")
    def hashed(paths: pd.Series, digests: pd.Series) -> pd.Series:
        return pd.Series([None if p is None else leaf(p, d).hex() for p, d in zip(paths, digests)])

    rows = files.select("path", "sha256")
    if former is None:
        return rows.select("path", "sha256", hashed("path", "sha256").alias("entry"), F.lit(False).alias("reused"))
    old = former.select("path", "sha256", F.col("entry").alias("old"))
    known = rows.join(old, ["path", "sha256"], "left")
    fresh = F.col("old").isNull()
    # Only paths that are new or changed reach Python; the others go through as nulls.
    made = hashed(F.when(fresh, F.col("path")), F.col("sha256"))
    return known.select("path", "sha256", F.coalesce("old", made).alias("entry"), (~fresh).alias("reused"))
