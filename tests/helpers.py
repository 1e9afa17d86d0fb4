"""Small logs and brute-force twins."""

from __future__ import annotations

import random

WRITE = "vault_id string, file_id string, ms long, cnt long, node string"
CTX = "vault_id string, file_id string, node string, h struct<ms:long,cnt:long>"


def random_log(seed: int, n: int = 60, files: int = 3, nodes: int = 3):
    """Writes with contexts a real device could have: a subset of earlier writes per node."""
    rnd = random.Random(seed)
    log = []
    for i in range(n):
        f, node = f"f{rnd.randrange(files)}", f"d{rnd.randrange(nodes)}"
        ms, cnt = 1000 + i // 2, i % 2
        ctx: dict[str, tuple[int, int]] = {}
        for w in log:
            if w["file"] == f and (w["node"] == node or rnd.random() < 0.5):
                ctx[w["node"]] = max(ctx.get(w["node"], (0, 0)), (w["ms"], w["cnt"]))
        log.append({"file": f, "node": node, "ms": ms, "cnt": cnt, "ctx": ctx})
    return log


def frames(spark, log):
    w = [("v", x["file"], x["ms"], x["cnt"], x["node"], i) for i, x in enumerate(log)]
    c = [("v", x["file"], n, h, i) for i, x in enumerate(log) for n, h in x["ctx"].items()]
    return (spark.createDataFrame(w, WRITE + ", arrival long"),
            spark.createDataFrame(c, CTX + ", arrival long"))


def contains(ctx, w) -> bool:
    return w["node"] in ctx and ctx[w["node"]] >= (w["ms"], w["cnt"])


def lattice(log):
    return {(w["file"], w["ms"], w["cnt"], w["node"]) for w in log
            if not any(o is not w and o["file"] == w["file"] and contains(o["ctx"], w) for o in log)}


def server(log):
    kept = []
    for w in log:
        kept = [k for k in kept if not (k["file"] == w["file"] and contains(w["ctx"], k))]
        kept.append(w)
    return {(w["file"], w["ms"], w["cnt"], w["node"]) for w in kept}


def keys_of(df):
    return {tuple(r) for r in df.select("file_id", "ms", "cnt", "node").collect()}
