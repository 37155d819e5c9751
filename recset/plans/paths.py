"""Path construction queries on the city graph."""
from pyspark.sql import functions as F

from recset.operators import paths as pt, sequence as s, walks as wk
from recset.plans import query
from recset.plans.profiles import _r, city_queries
from recset.plans.rankers import text
from recset.plans.sequences import FACTORED_SQL, KINDS, city, class_pairs, factored, five_values, matrices, vec
from recset.session import share
from recset.sources import views as v

# Steps between all POI: node part and edge part, each in whole micro-units.
EW = FACTORED_SQL + """, node AS (SELECT poi, log10(pop::DOUBLE / sum(pop) OVER ()) AS nw FROM cinfo),
    ew AS (SELECT src, dst, nw, w, round(0.5 * nw * 1000000)::BIGINT + round(0.5 * w * 1000000)::BIGINT AS m FROM wts JOIN node ON node.poi = dst WHERE src <> dst)"""
NEED = "cseq cinfo cpoi cquery ctraj"
ALPHA = 0.5
TOP = 10


def node_weights(seq):
    """(poi, nw, weight): log10 softmax of the node score (log popularity), and its share in micro-units."""
    info = s.poi_info(seq).select("poi", F.ln("pop").alias("score"))
    top = info.agg(F.max("score")).scalar()
    info = info.withColumn("e", F.exp(F.col("score") - top))
    z = info.agg(F.sum("e")).scalar()
    return info.select("poi", F.log10(F.col("e") / z).alias("nw")).withColumn("weight", F.round(ALPHA * F.col("nw") * wk.MICRO).cast("long"))


def setup(spark, sf):
    """Queries, their starts with classes, the class store and the greatest length."""
    _, seq = city(spark, sf)
    _, vecs, tm = matrices(spark, sf, seq)
    q = share(city_queries(share(s.paths(seq).select("start", "len"))))
    longest = q.agg(F.max("len")).first()[0] or 0
    store = wk.class_store(vecs, tm, node_weights(seq), KINDS, 1 - ALPHA, longest + TOP)
    return q, wk.starts_with_classes(q, vecs, KINDS), store, longest


@query("path_combine", "SELECT src, dst, round(nw, 6) AS node, round(w, 6) AS edge, m AS weight FROM ew", NEED, EW)
def path_combine(spark, sf):
    """Edge weights of every ordered pair of POI: alpha * log10 softmax of the node score + (1 - alpha) * log10 transition. Both
    parts come from classes and POI; the pairs are joined from them only here, where they are the result."""
    _, seq = city(spark, sf)
    _, vecs, tm = matrices(spark, sf, seq)
    side = lambda pre, key: vecs.select(F.col("poi").alias(key), *[F.col(k).alias(pre + k) for k in KINDS])
    to = side("b_", "dst").join(node_weights(seq).withColumnRenamed("poi", "dst"), "dst")
    d = side("a_", "src").join(class_pairs(vecs, tm), [f"a_{k}" for k in KINDS]).join(to, [f"b_{k}" for k in KINDS]).filter("src <> dst")
    weight = F.col("weight") + F.round((1 - ALPHA) * F.col("w") * wk.MICRO).cast("long")
    return d.select("src", "dst", _r("nw", "node"), _r("w", "edge"), weight.alias("weight"))


VIT = """, vit AS (SELECT start, start AS poi, 1 AS n, 0::BIGINT AS score, [start] AS path FROM (SELECT DISTINCT start FROM cquery) UNION ALL
    SELECT start, dst, n + 1, max(sc), arg_min(p, (-sc, p)) FROM (SELECT start, dst, n, score + m AS sc, list_append(path, dst) AS p FROM vit JOIN ew ON src = poi WHERE dst <> start AND dst <> poi AND n < (SELECT max(len) FROM cquery))
    GROUP BY start, dst, n)"""


@query("path_viterbi", "SELECT qid, array_to_string(arg_min(path, (-score, path)), ',') AS path, max(score) AS score FROM cquery q JOIN vit ON vit.start = q.start AND vit.n = q.len GROUP BY qid", NEED, EW + VIT, recursive=True)
def path_viterbi(spark, sf):
    q, st, store, _ = setup(spark, sf)
    return q.join(wk.each_length(st, store, wk.best_walks), ["start", "len"]).select("qid", text(F.col("path")).alias("path"), "score")


def BEAM(width):
    return f""", bm AS (SELECT start, start AS poi, 1 AS n, 1::BIGINT AS rank, 0::BIGINT AS score, [start] AS path FROM (SELECT DISTINCT start FROM cquery) UNION ALL
    SELECT start, dst, n + 1, rank, sc, p FROM (SELECT *, row_number() OVER (PARTITION BY start ORDER BY sc DESC, p) AS rank FROM (
    SELECT start, dst, n, score + m AS sc, list_append(path, dst) AS p FROM bm JOIN ew ON src = poi WHERE NOT list_contains(path, dst) AND n < (SELECT max(len) FROM cquery))) WHERE rank <= {width})"""


@query("path_greedy", "SELECT qid, array_to_string(path, ',') AS path, score FROM cquery q JOIN bm ON bm.start = q.start AND bm.n = q.len", NEED, EW + BEAM(1), recursive=True)
def path_greedy(spark, sf):
    q, st, store, _ = setup(spark, sf)
    return q.join(wk.each_length(st, store, wk.best_greedy), ["start", "len"]).select("qid", text(F.col("path")).alias("path"), "score")


# All loop-free paths, ranked per start and length. A partial path is left out only where a bound proves that ten paths are
# better for every length that its start asks for: the ten of a beam are known, and the rest of a path weighs at most the best
# walk, and at most the best reduced walk plus the best inward steps of as many unused POI.
FULL = BEAM(50).replace("bm", "wide") + """, lows AS (SELECT q.start, q.len, CASE WHEN count(w.score) >= 10 THEN min(w.score) ELSE -4000000000000 END AS low FROM cquery q
      LEFT JOIN wide w ON w.start = q.start AND w.n = q.len AND w.rank <= 10 GROUP BY 1, 2),
    asked AS MATERIALIZED (SELECT start, list({'l': len, 'low': low} ORDER BY len) AS lens FROM lows GROUP BY start),
    inward AS (SELECT dst AS poi, max(m) AS lam FROM ew GROUP BY dst),
    walk0 AS (SELECT poi, 0 AS r, 0::BIGINT AS b FROM cinfo UNION ALL SELECT src, r + 1, max(m + b) FROM walk0 JOIN ew ON dst = walk0.poi WHERE r + 1 < (SELECT max(len) FROM cquery) GROUP BY src, r),
    walk1 AS (SELECT poi, 0 AS r, 0::BIGINT AS b FROM cinfo UNION ALL SELECT src, r + 1, max(m - lam + b) FROM walk1 JOIN ew ON dst = walk1.poi JOIN inward ON inward.poi = dst WHERE r + 1 < (SELECT max(len) FROM cquery) GROUP BY src, r),
    rests AS MATERIALIZED (SELECT poi, list(walk0.b ORDER BY r) AS plain, list(walk1.b ORDER BY r) AS reduced FROM walk0 JOIN walk1 USING (poi, r) GROUP BY poi),
    lams AS MATERIALIZED (SELECT list({'poi': poi, 'lam': lam} ORDER BY lam DESC, poi) AS ls FROM inward),
    every AS (SELECT start, start AS poi, 1 AS n, 0::BIGINT AS score, [start] AS path FROM asked UNION ALL
      SELECT start, poi, n, score, path FROM (SELECT *, list_transform(list_filter(ls, lambda e: NOT list_contains(path, e.poi)), lambda e: e.lam) AS free FROM (
        SELECT every.start, dst AS poi, every.n + 1 AS n, score + m AS score, list_append(path, dst) AS path, plain, reduced,
          list_filter(lens, lambda x: x.l > every.n AND every.score + m + plain[x.l - every.n] >= x.low) AS lens FROM every JOIN asked USING (start) JOIN ew ON src = every.poi JOIN rests ON rests.poi = dst
        WHERE NOT list_contains(path, dst)), lams WHERE len(lens) > 0)
      WHERE len(list_filter(lens, lambda x: x.l = n OR score + reduced[x.l - n + 1] + list_sum(free[1:x.l - n]) >= x.low)) > 0),
    bm AS (SELECT * FROM (SELECT start, n, path, score, row_number() OVER (PARTITION BY start, n ORDER BY score DESC, path) AS rank FROM every) WHERE rank <= 10)"""
TOP_SQL = "SELECT qid, rank, array_to_string(path, ',') AS path, score FROM cquery q JOIN bm ON bm.start = q.start AND bm.n = q.len"


@query("path_beam_topk", TOP_SQL, NEED, EW + FULL, recursive=True)
def path_beam_topk(spark, sf):
    """The ten best loop-free paths; a beam only gives the search its first bound, so none is lost."""
    q, st, store, longest = setup(spark, sf)
    return q.join(wk.top_paths(st, store, longest, TOP), ["start", "len"]).select("qid", F.col("rank").cast("long").alias("rank"), text(F.col("path")).alias("path"), "score")


# Since `path_beam_topk` is exact, the two are one.
query("path_exact_topk", TOP_SQL, NEED, EW + FULL, recursive=True)(path_beam_topk)


DIV = """, kept AS (SELECT start, n, rank, path AS last, TRUE AS keep FROM bm WHERE rank = 1 AND n >= 2 UNION ALL
    SELECT k.start, k.n, b.rank, CASE WHEN len(list_filter(b.path, lambda x: NOT list_contains(k.last, x))) > 0 THEN b.path ELSE k.last END,
    len(list_filter(b.path, lambda x: NOT list_contains(k.last, x))) > 0 FROM kept k JOIN bm b ON b.start = k.start AND b.n = k.n AND b.rank = k.rank + 1 WHERE b.rank <= 10)"""


DIVERSE_SQL = "SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY rank) AS rank, array_to_string(last, ',') AS path FROM cquery q JOIN kept k ON k.start = q.start AND k.n = q.len WHERE keep"


@query("path_diverse", DIVERSE_SQL, NEED, EW + FULL + DIV, recursive=True)
def path_diverse(spark, sf):
    """Of the ten best paths, those with a POI that the last kept one lacks."""
    q, st, store, longest = setup(spark, sf)
    top = wk.top_paths(st, store, longest, TOP)
    arr = top.groupBy("start", "len").agg(F.array_sort(F.collect_list(F.struct("rank", "path"))).alias("a")).select("start", "len", F.transform("a", lambda x: x["path"]).alias("paths"))
    d = q.join(pt.keep_diverse(arr), ["start", "len"]).select("qid", F.posexplode("paths").alias("i", "path"))
    return d.select("qid", (F.col("i") + 1).cast("long").alias("rank"), text(F.col("path")).alias("path"))


query("path_exact_diverse", DIVERSE_SQL, NEED, EW + FULL + DIV, recursive=True)(path_diverse)


@query("path_decompose", """SELECT a.traj, a.n_steps, a.node, a.edge, a.total, f.cat, f.pop FROM (SELECT a.traj, count(*) AS n_steps, round(sum(0.5 * nw), 6) AS node, round(sum(0.5 * w), 6) AS edge, sum(m)::BIGINT AS total FROM cseq a JOIN cseq b ON a.traj = b.traj AND b.ord = a.ord + 1
    JOIN ew ON ew.src = a.poi AND ew.dst = b.poi GROUP BY a.traj) a JOIN (SELECT a.traj, round(sum(log10(tm_cat.p)), 6) AS cat, round(sum(log10(tm_pop.p)), 6) AS pop FROM cseq a JOIN cseq b ON a.traj = b.traj AND b.ord = a.ord + 1 JOIN vec x ON x.poi = a.poi JOIN vec y ON y.poi = b.poi
    JOIN tm_cat ON tm_cat.c1 = x.cat AND tm_cat.c2 = y.cat JOIN tm_pop ON tm_pop.c1 = x.pop AND tm_pop.c2 = y.pop GROUP BY a.traj) f USING (traj)""", NEED, EW)
def path_decompose(spark, sf):
    """Score of every given path split into node part, edge part and single transition features."""
    _, seq = city(spark, sf)
    w = factored(spark, sf, seq).withColumnRenamed("w", "w2").join(node_weights(seq).withColumnRenamed("poi", "dst"), "dst")
    e = share(w.select("src", "dst", (F.col("weight") + F.round((1 - ALPHA) * F.col("w2") * wk.MICRO).cast("long")).alias("w"), "w2", "nw"))
    edges, vecs, tm = matrices(spark, sf, seq)
    f = five_values(edges.select("src", "dst").join(vec(vecs, "a_", "src"), "src").join(vec(vecs, "b_", "dst"), "dst"), tm).select("src", "dst", F.log10("p_cat").alias("f_cat"), F.log10("p_pop").alias("f_pop"))
    e = e.join(f, ["src", "dst"])
    return s.steps(seq).join(e, ["src", "dst"]).groupBy("traj").agg(
        F.count("*").alias("n_steps"), _r(F.sum(ALPHA * F.col("nw")), "node"), _r(F.sum((1 - ALPHA) * F.col("w2")), "edge"), F.sum("w").alias("total"),
        _r(F.sum("f_cat"), "cat"), _r(F.sum("f_pop"), "pop"))
