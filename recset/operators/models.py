"""Model fits as Spark jobs: pyspark.ml where it has the estimator, grouped aggregates elsewhere."""
from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.recommendation import ALS
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, functions as F

from recset.functions import columns as c
from recset.operators import multitask as mt, ordering as o
from recset.operators.word_vectors import skip_gram
from recset.session import cut, discard

# Fixed values of the implicit-feedback weight 1 + alpha * ln(1 + r / eps).
WMF_ALPHA, WMF_EPS = 40.0, 1e-8


def kmeans(points: DataFrame, cols: list[str], k: int = 5, seed: int = 1) -> DataFrame:
    d = points.withColumn("features", array_to_vector(F.array(*[F.col(x).cast("double") for x in cols])))
    return KMeans(k=k, seed=seed).fit(d).transform(d).drop("features").withColumnRenamed("prediction", "cluster")


def embeddings(sentences: DataFrame, words: str, size: int) -> DataFrame:
    """Word vectors over item sequences (window 10, 10 passes)."""
    return skip_gram(sentences, words, size, 10, 10)


def wmf(cells: DataFrame, user: str, item: str, r: str, rank: int, sweeps: int):
    rated = cells.select(user, item, F.log1p(F.col(r) / WMF_EPS).cast("float").alias("rating"))
    return ALS(userCol=user, itemCol=item, ratingCol="rating", implicitPrefs=True, alpha=WMF_ALPHA, rank=rank, maxIter=sweeps, regParam=0.1, seed=0).fit(rated)


def ratings_als(cells: DataFrame, user: str, item: str, rating: str, rank: int, sweeps: int):
    return ALS(userCol=user, itemCol=item, ratingCol=rating, rank=rank, maxIter=sweeps, regParam=0.1, seed=0, coldStartStrategy="drop").fit(cells)


def _gram(vecs: DataFrame, d: int) -> list:
    """sum of v v^T as a d x d matrix: partial sums per task, d*d numbers to the driver whatever the number of rows."""
    cells = [F.sum(F.get("vec", i) * F.get("vec", j)).alias(f"c{i}_{j}") for i in range(d) for j in range(i, d)]
    r = vecs.agg(*cells).first()
    return [[r[f"c{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(d)] for i in range(d)]


def dense_mf(cells: DataFrame, row: str, col: str, d: int, sweeps: int, reg: float, seed: str = "mf"):
    """Y ~ S P^T with weight 1 on all cells, zeros included; only the ones are stored.

    Half a sweep solves (Q^T Q + reg I) x = sum of q over the ones of a row: a d x d solve on the driver, a join and a
    grouped sum over the ones, and a map. Returns both factor tables and the objective after each sweep.
    """
    import numpy as np

    ids = lambda k: cells.select(k).distinct()
    noise = lambda k: F.array(*[F.conv(F.substring(o.md5_of(k, seed=f"{seed}{i}"), 1, 6), 16, 10).cast("double") / 16777216.0 - 0.5 for i in range(d)])
    q = cut(ids(col).select(col, noise(col).alias("vec")), "mf")
    ones = cells.count()
    objective, p = [], None

    def half(fixed, key, other):
        inv = np.linalg.inv(np.array(_gram(fixed, d)) + reg * np.eye(d))
        s = cells.join(fixed, key).groupBy(other).agg(*[F.sum(F.get("vec", i)).alias(f"s{i}") for i in range(d)])
        vec = F.array(*[sum((F.col(f"s{j}") * float(inv[i, j]) for j in range(d)), F.lit(0.0)) for i in range(d)])
        return cut(s.select(other, vec.alias("vec")), "mf")

    for _ in range(sweeps):
        p = half(q, col, row)
        q = half(p, row, col)
        gp, gq = np.array(_gram(p, d)), np.array(_gram(q, d))
        hit = cells.join(p.withColumnRenamed("vec", "a"), row).join(q.withColumnRenamed("vec", "b"), col).agg(F.sum(c.dot(F.col("a"), F.col("b")))).first()[0]
        objective.append(float(ones - 2 * hit + np.sum(gp * gq) + reg * (np.trace(gp) + np.trace(gq))))
    return p, q, objective


def logistic(train: DataFrame, test: DataFrame, x: Column, y: str, **kw) -> DataFrame:
    """Probability of the positive class for the rows of `test`."""
    prep = lambda d: d.withColumn("features", array_to_vector(x))
    m = LogisticRegression(featuresCol="features", labelCol=y, **kw).fit(prep(train))
    return m.transform(prep(test)).withColumn("score", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def linear(train: DataFrame, test: DataFrame, x: Column, y: str, **kw) -> DataFrame:
    prep = lambda d: d.withColumn("features", array_to_vector(x))
    m = LinearRegression(featuresCol="features", labelCol=y, **kw).fit(prep(train))
    return m.transform(prep(test)).withColumnRenamed("prediction", "score").drop("features")


def hinge_rank_value(rows: DataFrame, d: int, reg: float):
    """Linear ranking with the pairwise squared hinge max(0, 1 - (s+ - s-))^2 over all (positive, negative) pairs of a query.

    No pair is formed. Rows are merged on one axis, negatives at s and positives at s - 1: the partners of a positive are
    the negatives at or above it, those of a negative the positives at or below it. Running sums of 1, s and x along the
    axis give value and gradient exactly, and a hot query is spread because the running sums are bucketed.
    rows: (qid, id, pos 0/1, x array). Returns a function from weights to (loss, gradient).
    """
    import numpy as np

    n = rows.groupBy("qid").agg(F.sum("pos").alias("np"), F.sum(1 - F.col("pos")).alias("nn")).filter("np > 0 and nn > 0")
    base = cut(rows.join(n, "qid").withColumn("wt", 1.0 / (F.col("np") * F.col("nn"))), "rank")
    queries = n.count()

    def value(w):
        s = c.dot(F.col("x"), F.array(*[F.lit(float(v)) for v in w]))
        r = base.withColumn("s", s).withColumn("at", F.col("s") - F.col("pos")).withColumn("k", F.floor(F.col("at") * 64).cast("long"))
        side = lambda p: F.when(F.col("pos") == p, 1.0).otherwise(0.0)
        # negatives at or above: descending order, negatives before positives on ties
        up = o.running(r, ["qid"], [F.desc("at"), "pos", "id"], -F.col("k"), {"c0": side(0), "s0": side(0) * F.col("s"), "q0": side(0) * F.col("s") * F.col("s")})
        both = o.running(up, ["qid"], ["at", F.desc("pos"), "id"], F.col("k"), {"c1": side(1), "s1": side(1) * F.col("s")})
        # derivative of the loss by the score of a row, over 2: sum of -(1 - s+ + s-) for a positive, + for a negative
        g_pos = -(F.col("c0") * (1 - F.col("s")) + F.col("s0"))
        g_neg = F.col("c1") * (1 + F.col("s")) - F.col("s1")
        gs = F.when(F.col("pos") == 1, g_pos).otherwise(g_neg) * 2 * F.col("wt")
        loss = F.when(F.col("pos") == 1, F.col("c0") * (1 - F.col("s")) * (1 - F.col("s")) + 2 * (1 - F.col("s")) * F.col("s0") + F.col("q0")).otherwise(0.0) * F.col("wt")
        t = both.agg(F.sum(loss).alias("loss"), *[F.sum(gs * F.get("x", i)).alias(f"g{i}") for i in range(d)]).first()
        if not queries:  # no pair, so only the norm counts
            return 0.5 * reg * float(w @ w), reg * w
        return t["loss"] / queries + 0.5 * reg * float(w @ w), np.array([t[f"g{i}"] for i in range(d)]) / queries + reg * w

    return value


def hinge_rank_fit(rows: DataFrame, d: int, steps: int, rate: float, reg: float):
    """A given number of gradient steps on `hinge_rank_value`. Returns (weights, losses)."""
    import numpy as np

    value = hinge_rank_value(rows, d, reg)
    w, losses = np.zeros(d), []
    for _ in range(steps):
        loss, g = value(w)
        losses.append(loss)
        w = w - rate * g
    return w, losses


def hinge_rank_solve(rows: DataFrame, d: int, rate: float, reg: float, tol: float = 1e-3):
    """Gradient steps on `hinge_rank_value` until one lowers the loss by less than `tol` of its first value. Returns
    (weights, losses).

    The first step has length `rate`; later ones follow the curvature seen in the last step. A step that raises the loss is
    taken back and tried again at a quarter of its length, so the losses never rise.
    """
    import numpy as np

    value = hinge_rank_value(rows, d, reg)
    w = np.zeros(d)
    loss, g = value(w)
    losses = [loss]
    while loss > 0 and rate * float(g @ g) > 1e-12 * losses[0]:
        to = w - rate * g
        low, grad = value(to)
        if low > loss:
            rate /= 4
            continue
        step, turn, gain = to - w, grad - g, loss - low
        w, loss, g = to, low, grad
        losses.append(loss)
        if gain < tol * losses[0]:
            break
        if step @ turn > 0:
            rate = float(step @ step / (step @ turn))
    return w, losses


SONGS, LISTS = 2048, 1024  # of a block; a task holds the scores of one pair of blocks
PART = 1 << 25  # bytes of vectors that a task packs into slices, about


def list_gradients(spark, rows: DataFrame, x, d: int, p: float, n_lists: int) -> DataFrame:
    """rows(pid, usr, w, t, ix) -> (pid, usr, w, g, risk): bottom-push risk of each list and its gradient by t.

    `x` is the broadcast song matrix; `ix` are the row numbers of the list's songs. Negatives are all other songs, whose
    sum is the sum over all songs minus that over the list. A task handles small blocks of lists against the matrix.
    For a matrix that is at hand; `mtc_fit` takes `block_gradients`.
    """
    mat = spark.sparkContext.broadcast(x)

    def solve(batches):
        import numpy as np
        import pandas as pd

        X = mat.value
        for b in batches:
            for lo in range(0, len(b), 64):
                part = b.iloc[lo:lo + 64]
                T = np.array(part["t"].tolist())
                e = np.exp(X @ T.T)  # songs x 64 lists
                tot, totx = e.sum(0), e.T @ X
                g, risk = [], []
                for k, ix in enumerate(part["ix"]):
                    P = X[np.asarray(ix)]
                    a, en = np.exp(-p * (P @ T[k])), e[np.asarray(ix), k]
                    nn = len(X) - len(P)
                    risk.append((a.sum() / len(P) / p + (tot[k] - en.sum()) / nn) / n_lists)
                    g.append((((totx[k] - en @ P) / nn - (a @ P) / len(P)) / n_lists).tolist())
                yield pd.DataFrame({"pid": part["pid"], "usr": part["usr"], "w": part["w"], "g": g, "risk": risk})

    return rows.mapInPandas(solve, "pid long, usr long, w array<double>, g array<double>, risk double")


def blocks(rows: DataFrame, key: str, size: int, **cols) -> DataFrame:
    """Rows dealt by hash into blocks of about `size`, each column as one array."""
    k = F.pmod(F.xxhash64(key), F.lit(max(1, -(-rows.count() // size))))
    return rows.groupBy(k.alias("_k")).agg(*[F.collect_list(x).alias(n) for n, x in cols.items()]).drop("_k")


def dealt_join(rows: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    """Join with a table of vectors, never by broadcast: vectors that are equal or zero take next to nothing in a file, so Spark's
    size check would take a table of any number of rows to the driver."""
    return rows.join(vectors.hint("merge"), key)


def vector_sums(rows: DataFrame, key: str, vec: str, d: int) -> DataFrame:
    return rows.groupBy(key).agg(F.array(*[F.sum(F.get(vec, i)) for i in range(d)]).alias(vec))


def block_totals(song_blocks: DataFrame, rows: DataFrame, d: int) -> DataFrame:
    """(pid, all) of rows(pid, t): the sums of exp-scores and of their gradient over every song, by pairs of blocks. Lists of a block
    with equal weights are scored once."""

    def every(batches):
        import numpy as np
        import pandas as pd

        for b in batches:
            for x, pids, t in zip(b["x"], b["pids"], b["ts"]):
                x, (t, at) = np.array(x.tolist()), np.unique(np.array(t.tolist()), axis=0, return_inverse=True)
                e = np.exp(x @ t.T)
                yield pd.DataFrame({"pid": pids, "all": list(np.column_stack([e.sum(0), e.T @ x])[at.ravel()])})

    lists = blocks(rows, "pid", LISTS, both=F.struct("pid", "t")).select(F.col("both.pid").alias("pids"), F.col("both.t").alias("ts"))
    return vector_sums(song_blocks.hint("shuffle_replicate_nl").crossJoin(lists).mapInPandas(every, "pid long, all array<double>"), "pid", "all", d + 1)


def block_gradients(song_blocks: DataFrame, pos: DataFrame, rows: DataFrame, d: int, p: float, n_songs: int, n_lists: int, total: DataFrame | None = None) -> DataFrame:
    """rows(pid, usr, n, w, t) -> (pid, usr, w, g, risk) like `list_gradients`, with songs and lists both distributed.

    song_blocks(x: array of vectors), every song in one block; pos(pid, x), the songs of the lists; n songs are in a list.
    total(pid, all) are the sums over every song, where they are known.
    """

    def own(batches):
        import numpy as np
        import pandas as pd

        for b in batches:
            if not len(b):
                continue
            x, t = np.array(b["x"].tolist()), np.array(b["t"].tolist())
            s = (x * t).sum(1)
            a, e = np.exp(-p * s)[:, None], np.exp(s)[:, None]
            pids, at = np.unique(b["pid"], return_inverse=True)
            v = np.zeros((len(pids), 2 * d + 2))
            np.add.at(v, at, np.hstack([a, a * x, e, e * x]))
            yield pd.DataFrame({"pid": pids, "own": list(v)})

    total = block_totals(song_blocks, rows, d) if total is None else total
    mine = vector_sums(dealt_join(pos, rows.select("pid", "t"), "pid").select("pid", "x", "t").mapInPandas(own, "pid long, own array<double>"), "pid", "own", 2 * d + 2)
    away = F.lit(n_songs) - F.col("n")
    # Per slot (0 is the sum of weights): mean over the songs outside the list, and over those inside.
    out = F.zip_with("all", F.slice("own", d + 2, d + 1), lambda x, y: F.when(away > 0, (x - y) / away).otherwise(F.lit(0.0)))
    inside = F.transform(F.slice("own", 1, d + 1), lambda x: x / F.col("n"))
    r = dealt_join(dealt_join(rows, total, "pid"), mine, "pid").withColumn("out", out).withColumn("in", inside)
    g = F.zip_with(F.slice("out", 2, d), F.slice("in", 2, d), lambda x, y: (x - y) / n_lists)
    return r.select("pid", "usr", "w", g.alias("g"), ((F.get("in", 0) / p + F.get("out", 0)) / n_lists).alias("risk"))


def loose_step(song_blocks, table: dict, mu, m, terms: int, radius: float, p: float, n_songs: int, n_lists: int, rate: float, c1: float, c2: float):
    """A step for lists whose weights are rows: table has entries(pid, x), lists(pid, usr, n, w) and users(usr, v). Returns the table
    after it and the sums of `multitask.step`."""
    import numpy as np

    d = len(mu)
    add = lambda a, b: F.zip_with(a, b, lambda q, y: q + y)
    norm = lambda a: F.sqrt(F.aggregate(a, F.lit(0.0), lambda q, y: q + y * y))
    delta = add(F.col("w"), F.col("v"))
    r = dealt_join(table["lists"], table["users"], "usr").select("pid", "usr", "w", "n", add(delta, F.array(*[F.lit(float(x)) for x in mu])).alias("t"), (F.lit(radius) * norm(delta)).alias("far"))
    r = cut(r, "mtc")
    near = F.coalesce(~F.isnan("far") & (F.col("far") <= mt.reach(terms)), F.lit(False))
    total = mt.series_totals(r.filter(near), mu, m, terms, radius).unionByName(block_totals(song_blocks, r.filter(~near), d))
    g = cut(block_gradients(song_blocks, table["entries"], r, d, p, n_songs, n_lists, total), "mtc")
    gv = cut(dealt_join(vector_sums(g, "usr", "g", d).withColumnRenamed("g", "gv"), table["users"], "usr"), "mtc")
    tot = gv.agg(*[F.sum(F.get("gv", i)).alias(f"g{i}") for i in range(d)], F.sum(c.dot(F.col("v"), F.col("v"))).alias("vv")).first()
    part = g.agg(F.sum("risk").alias("risk"), F.sum(F.aggregate("w", F.lit(0.0), lambda a, q: a + F.abs(q))).alias("l1")).first()
    shrink = lambda q: F.signum(q) * F.greatest(F.abs(q) - F.lit(rate * c2), F.lit(0.0))
    w = g.select("pid", F.zip_with("w", "g", lambda q, y: shrink(q - rate * y)).alias("w"))
    lists = cut(dealt_join(table["lists"].drop("w"), w, "pid"), "mtc")
    users = cut(gv.select("usr", F.zip_with("v", "gv", lambda q, y: q - rate * (y + c1 * q)).alias("v")), "mtc")
    return {"entries": table["entries"], "lists": lists, "users": users}, np.array([*[tot[f"g{i}"] for i in range(d)], tot["vv"], part["risk"], part["l1"]])


def mtc_fit(songs: DataFrame, entries: DataFrame, lists: DataFrame, d: int, p: float, c1: float, c2: float, steps: int, rate: float):
    """Multitask fit: score = x . (w_list + v_user + mu) on the bottom-push risk, proximal gradient steps.

    Objective: mean over lists of sum_pos exp(-p s)/(p n+) + sum_neg exp(s)/n-, plus c1 |v|^2 / 2 and c2 |(w, mu)|_1.
    songs (song, x); entries (pid, song), distinct; lists (pid, usr). Songs, lists and their weights stay distributed. Lists lie in
    slices (see `multitask`); those of users of more songs than a slice holds, and those whose weights leave the reach of the series,
    are rows and meet every song in pairs of blocks. A pid of several users is one list of each of them.
    """
    import numpy as np

    songs = cut(songs.withColumn("sid", F.monotonically_increasing_id()), "mtc")
    stats = songs.agg(F.count("*").alias("n"), F.max(F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, q: a + q * q))).alias("radius")).first()
    n_songs, radius = stats["n"], float(stats["radius"] or 0.0)
    vecs = songs.select("sid", "x")
    songs = cut(songs.repartition("sid"), "mtc")
    song_blocks = cut(blocks(vecs, "sid", SONGS, x=F.col("x")), "mtc")
    entries = cut(dealt_join(entries, songs.select("song", "sid"), "song").select("pid", "sid"), "mtc")
    pos = entries.groupBy("pid").agg(F.count("*").alias("n")).join(lists, "pid").select(F.monotonically_increasing_id().alias("id"), "pid", "usr", "n")
    pos = cut(pos, "mtc")
    terms = mt.degree(d)
    size = max(1, mt.SLICE // max(d, 1))
    whole = pos.groupBy("usr").agg(F.sum("n").alias("k")).filter(f"k <= {size}").select("usr")
    some = cut(pos.join(whole, "usr"), "mtc")
    rest = cut(pos.join(whole, "usr", "left_anti").filter("usr is not null"), "mtc")
    count = pos.agg(F.count("*").alias("lists"), F.sum("n").alias("songs")).first()
    n_lists, n = count["lists"], max(-(-(count["songs"] or 0) * d * 8 // PART), int(songs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    of = lambda rows: dealt_join(dealt_join(entries, rows.select("pid", "id", "usr"), "pid").select("id", "usr", "sid"), vecs, "sid").select("usr", F.col("id").alias("pid"), "x")
    zero = F.array(*[F.lit(0.0)] * d)
    state = cut(mt.slices(of(some), d, n), "mtc")
    as_rows = lambda f, *tables: {k: cut(f(*[t[k] for t in tables]), "mtc") for k in ("entries", "lists", "users")}
    loose = None
    if rest.limit(1).count():
        loose = as_rows(lambda x: x, {"entries": of(rest).select("pid", "x"), "lists": rest.select(F.col("id").alias("pid"), "usr", "n", zero.alias("w")), "users": rest.select("usr").distinct().select("usr", zero.alias("v"))})
    mu, losses = np.zeros(d), []
    for _ in range(steps):
        m = mt.moments(songs, mu, terms)
        old, state = state, cut(mt.step(state, mu, m, terms, radius, p, n_songs, n_lists, rate, c1, c2), "mtc")
        discard(old)
        sums = state.agg(*[F.coalesce(F.sum(F.get("sums", i)), F.lit(0.0)) for i in range(d + 3)], F.max("far")).first()
        sums, far = np.array(sums[:-1]), sums[-1] or 0.0
        if loose:
            loose, more = loose_step(song_blocks, loose, mu, m, terms, radius, p, n_songs, n_lists, rate, c1, c2)
            sums += more
        vv, risk, l1 = sums[d:]
        losses.append(float(risk + 0.5 * c1 * vv + c2 * (l1 + np.abs(mu).sum())))
        mu = mu - rate * sums[:d]
        mu = np.sign(mu) * np.maximum(np.abs(mu) - rate * c2, 0)
        if far > mt.reach(terms):
            left = mt.unpacked(state.filter(F.col("far") > mt.reach(terms)), d)
            left = dict(zip(("lists", "users", "entries"), left))
            loose = as_rows(lambda x, y: x.unionByName(y), left, loose) if loose else as_rows(lambda x: x, left)
            old, state = state, cut(state.filter(F.col("far") <= mt.reach(terms)), "mtc")
            discard(old)
    ids, users, _ = mt.unpacked(state, d)
    if loose:
        ids, users = ids.unionByName(loose["lists"]), users.unionByName(loose["users"])
    return dealt_join(ids.select(F.col("pid").alias("id"), "w"), pos.select("id", "pid"), "id").select("pid", "w"), users, mu, losses
