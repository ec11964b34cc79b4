"""Secret scans with corpus-wide ownership of candidates.

Every text is scanned whole. Candidates are known by a hash under a key that each run draws
anew; how many owners hold a hash, and in how many repositories, separates examples that are copied everywhere
from credentials that one owner has. Secrets themselves are never put into the result.
"""

from __future__ import annotations

import hashlib
import os
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.scratch import cut

#: Base kinds in their order: pattern, group that is the secret, least characters of it. Fixed values.
ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: Runs of 16 and more are the runs `[0-9a-f]+` that are long enough.
HEX = re.compile(r"[0-9a-f]{16,}")
BASE = (("assign", ASSIGN, 2, 12), ("access", ACCESS, 0, 18), ("hex", HEX, 0, 16))
#: Kinds of published token formats, whose spans are added.
FORMATS = (
    ("github", re.compile(r"(?<![A-Za-z0-9_])gh[pousr]_[A-Za-z0-9]{36,}"), 0, 40),
    ("slack", re.compile(r"(?<![A-Za-z0-9_-])xox[abprs]-[A-Za-z0-9-]{10,}"), 0, 15),
    ("google", re.compile(r"(?<![A-Za-z0-9_-])AIza[A-Za-z0-9_-]{35}"), 0, 39),
    ("stripe", re.compile(r"(?<![A-Za-z0-9_])[rs]k_live_[A-Za-z0-9]{16,}"), 0, 24),
    ("jwt", re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"), 0, 30),
    ("pem", re.compile(r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"), 0, 20),
)
#: Long mixed tokens outside all other spans.
TOKEN = re.compile(r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9a-z+/_-]*[A-Z])(?=[0-9A-Z+/_-]*[a-z])[A-Za-z0-9+/_-]{24,}={0,2}(?![A-Za-z0-9+/_=-])")
KINDS = tuple(x[0] for x in (*BASE, *FORMATS)) + ("token",)
NAMED_BASE = len(BASE)
#: Held by more owners, or by several holders in more repositories, than this, a candidate is a copied example.
MOST_OWNERS, MOST_REPOS = 2, 8


def scan(text: str) -> list[tuple[int, int, int, str]]:
    """(start, end, kind, secret), by start and kind; positions in code points."""
    found = []
    for kind, (_, pattern, group, least) in enumerate((*BASE, *FORMATS)):
        for m in pattern.finditer(text):
            if m.end(group) - m.start(group) >= least:
                found.append((m.start(), m.end(), kind, m[group]))
    taken = sorted((a, b) for a, b, _, _ in found)
    starts, reach = [a for a, _ in taken], list(accumulate((b for _, b in taken), max))
    for m in TOKEN.finditer(text):
        n = bisect_left(starts, m.end())  # spans that begin before the token's end
        if not n or reach[n - 1] <= m.start():
            found.append((m.start(), m.end(), len(KINDS) - 1, m[0]))
    return sorted(found, key=lambda x: (x[0], x[2], x[1]))


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


SCANNED = "id long, text_hash long, repo string, owner string, n array<long>, base_sha256 string, spans array<struct<start:int,stop:int,kind:int,hash:string>>"


def _scanned(key: bytes) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def named(secret: str) -> str:
        return hashlib.blake2b(secret.encode("utf-8", "surrogatepass"), key=key, digest_size=16).hexdigest()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            counts, digests, spans, hashes = [], [], [], []
            for text in pdf["text"]:
                text = text or ""
                found = scan(text)
                base = [(a, b, k) for a, b, k, _ in found if k < NAMED_BASE]
                counts.append([sum(k == i for _, _, k in base) for i in range(NAMED_BASE)])
                digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans.append([{"start": a, "stop": b, "kind": k, "hash": named(s)} for a, b, k, s in found])
                hashes.append(np.uint64(xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))).view(np.int64))
            yield pd.DataFrame({"id": pdf["id"], "text_hash": hashes, "repo": pdf["repo"], "owner": pdf["owner"], "n": counts, "base_sha256": digests, "spans": spans})

    return run


def secret_scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "doc_id", owner_col: str = "source"
) -> DataFrame:
    """Secrets of each row of ``docs``, with the verdict of the whole corpus.

    Returns id_col, n_assign, n_access, n_hex, base_sha256 (digest of the base spans), spans
    (kind:start:stop, comma-joined; a mixed token that is not live is token-copied), n_live
    (spans whose secret one owner holds, in however many repositories, or few owners in few
    repositories) and n_copied (the others), one row per input row.

    Null text: empty, without spans. Null owner or repository: not counted as one; what rows
    without an owner hold is judged by its repositories. Null ids
    and repeated rows are scanned like others; repeated rows count once for ownership.
    Empty table: empty result. Other columns are not read, whatever they are called.
    """
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.col(repo_col).cast("string").alias("repo"), F.col(owner_col).cast("string").alias("owner")
    )
    scanned = cut(rows.mapInPandas(_scanned(os.urandom(16)), SCANNED), "scanned")
    flat = scanned.select("id", "text_hash", "repo", "owner", F.explode("spans").alias("s")).select(
        "id", "text_hash", "repo", "owner", "s.start", "s.stop", "s.kind", "s.hash"
    )
    # distinct by (hash, holder) first, so that a secret which everyone holds is counted by many tasks
    owners = flat.select("hash", "owner").distinct().groupBy("hash").agg(F.count("owner").alias("owners"), F.count("*").alias("holders"))
    repos = flat.select("hash", "repo").distinct().groupBy("hash").agg(F.count("repo").alias("repos"))
    # a row without an owner is a holder of its own kind, so one owner alone has no such rows
    alone = (F.col("owners") == 1) & (F.col("holders") == 1)
    few = alone | ((F.col("owners") <= MOST_OWNERS) & (F.col("repos") <= MOST_REPOS))
    held = cut(owners.join(repos, "hash").select("hash", few.alias("live")), "held")
    judged = flat.join(held, "hash")
    kinds = F.array(*map(F.lit, KINDS))
    # one document's own spans; equal rows of a repeated document fall together in the set
    found = judged.groupBy("id", "text_hash").agg(F.array_sort(F.collect_set(F.struct("start", "kind", "stop", "live"))).alias("found"))
    found = cut(found, "found").withColumnsRenamed({"id": "fid", "text_hash": "fhash"})
    out = scanned.join(found, scanned["id"].eqNullSafe(F.col("fid")) & (scanned["text_hash"] == F.col("fhash")), "left")
    name = lambda x: F.when(~x["live"] & (x["kind"] == len(KINDS) - 1), "token-copied").otherwise(F.get(kinds, x["kind"]))
    named = F.transform("found", lambda x: F.concat_ws(":", name(x), x["start"].cast("string"), x["stop"].cast("string")))
    n = F.col("n")
    size = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long")
    return out.select(
        F.col("id").alias(id_col),
        F.get(n, F.lit(0)).alias("n_assign"), F.get(n, F.lit(1)).alias("n_access"), F.get(n, F.lit(2)).alias("n_hex"),
        "base_sha256",
        F.coalesce(F.array_join(named, ","), F.lit("")).alias("spans"),
        size(F.filter("found", lambda x: x["live"])).alias("n_live"),
        size(F.filter("found", lambda x: ~x["live"])).alias("n_copied"),
    )
