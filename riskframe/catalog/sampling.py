from pyspark.sql import functions as F

from riskframe.catalog.registry import OR, labelled_orders, query, r, rounded, table
from riskframe.operators import neighbours, sampling
from riskframe.operators.models import class_weights

KEY = ["o_orderkey"]
H = "md5('42|' || CAST(o_orderkey AS VARCHAR))"
RANKED = f"""{OR}, rk AS (SELECT *, row_number() OVER (ORDER BY {H}) AS rn,
  row_number() OVER (PARTITION BY label ORDER BY {H}) AS rc, count(*) OVER () AS n,
  count(*) OVER (PARTITION BY label) AS nc FROM o)"""


# consecutive parts of the order, the larger ones first
FOLD = """CAST(CASE WHEN {rank} <= ({size} % {k}) * ({size} // {k} + 1) THEN ({rank} - 1) // ({size} // {k} + 1)
  ELSE {size} % {k} + ({rank} - 1 - ({size} % {k}) * ({size} // {k} + 1)) // ({size} // {k}) END AS INTEGER)"""


@query("split_plain", f"""WITH {RANKED} SELECT o_orderkey, label,
  CASE WHEN rn <= ceil(n * 0.3) THEN 'test' ELSE 'train' END AS split FROM rk""")
def split_plain(spark, sf):
    return sampling.with_split(labelled_orders(spark, sf), KEY, 0.3).select("o_orderkey", "label", "split")


@query("split_stratified", f"""WITH {RANKED} SELECT o_orderkey, label,
  CASE WHEN rc <= floor(nc * 0.3 + 0.5) THEN 'test' ELSE 'train' END AS split FROM rk""")
def split_stratified(spark, sf):
    return sampling.with_split(labelled_orders(spark, sf), KEY, 0.3, label="label").select("o_orderkey", "label", "split")


@query("split_validation", f"""WITH {RANKED}, tr AS (SELECT o_orderkey, label FROM rk WHERE rc > floor(nc * 0.3 + 0.5)),
  v AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('43|' || CAST(o_orderkey AS VARCHAR))) AS rv,
    count(*) OVER (PARTITION BY label) AS nv FROM tr)
  SELECT o_orderkey, label, rv <= floor(nv * 0.1 + 0.5) AS is_validation FROM v""")
def split_validation(spark, sf):
    train, _ = sampling.train_test(labelled_orders(spark, sf), KEY, 0.3, label="label")
    return sampling.with_validation(train, KEY, "label", 0.1, seed=43).select("o_orderkey", "label", "is_validation")


@query("kfold_assign", f"WITH {RANKED} SELECT o_orderkey, {FOLD.format(rank='rn', size='n', k=5)} AS fold FROM rk")
def kfold_assign(spark, sf):
    return sampling.with_folds(labelled_orders(spark, sf), KEY, 5).select("o_orderkey", "fold")


@query("kfold_stratified", f"WITH {RANKED} SELECT o_orderkey, label, {FOLD.format(rank='rc', size='nc', k=3)} AS fold FROM rk")
def kfold_stratified(spark, sf):
    return sampling.with_folds(labelled_orders(spark, sf), KEY, 3, label="label").select("o_orderkey", "label", "fold")


RARE = f"""{OR.replace("% 6 = 0", "% 12 = 0")}, rk AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {H}) AS rc FROM o)"""


@query("sample_ratio_1_k", f"""WITH {RARE}, b AS (SELECT count(*) AS bad FROM o WHERE label = 1)
  SELECT k, o_orderkey, label FROM rk, b, unnest([1, 2, 3, 4, 5]) AS t(k) WHERE label = 1 OR rc <= k * bad""")
def sample_ratio_1_k(spark, sf):
    o = labelled_orders(spark, sf).withColumn("label", F.when(F.col("o_custkey") % 12 == 0, 1).otherwise(0))
    return sampling.ratio_samples(o, KEY, "label").select("k", "o_orderkey", "label")


NO_LABEL = f"""{OR}, x AS (SELECT o_orderkey, CASE WHEN o_custkey % 5 <> 0 THEN label END AS label FROM o),
  rk AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {H}) AS rc, count(*) OVER (PARTITION BY label) AS nc FROM x)"""


@query("split_null_label", f"""WITH {NO_LABEL} SELECT o_orderkey, label, CASE WHEN rc <= floor(nc * 0.3 + 0.5) THEN 'test' ELSE 'train' END AS split,
  {FOLD.format(rank='rc', size='nc', k=5)} AS fold FROM rk""")
def split_null_label(spark, sf):
    o = labelled_orders(spark, sf).withColumn("label", F.when(F.col("o_custkey") % 5 != 0, F.col("label")))
    marked = sampling.with_folds(sampling.with_split(o, KEY, 0.3, label="label"), KEY, 5, label="label")
    return marked.select("o_orderkey", "label", "split", "fold")


@query("sample_fixed_n", f"WITH {RANKED} SELECT o_orderkey, label FROM rk WHERE label = 1 OR rc <= 1000")
def sample_fixed_n(spark, sf):
    return sampling.fixed_sample(labelled_orders(spark, sf), KEY, "label", 1000).select("o_orderkey", "label")


@query("sample_hashed", f"WITH {RANKED} SELECT o_orderkey, label FROM rk WHERE rn <= 777")
def sample_hashed(spark, sf):
    return sampling.hash_sample(labelled_orders(spark, sf), KEY, 777).select("o_orderkey", "label")


@query("over_sample", f"""WITH {RANKED}, m AS (SELECT max(nc) AS top FROM rk)
  SELECT o_orderkey, label, CAST(c AS INTEGER) AS copy FROM rk, m,
    unnest(range(1, CAST(top // nc + CASE WHEN rc <= top % nc THEN 1 ELSE 0 END AS BIGINT) + 1)) AS t(c)""")
def over_sample(spark, sf):
    return sampling.over_sample(labelled_orders(spark, sf), KEY, "label").select("o_orderkey", "label", "copy")


@query("under_sample", f"WITH {RANKED}, m AS (SELECT min(nc) AS low FROM rk) SELECT o_orderkey, label FROM rk, m WHERE rc <= low")
def under_sample(spark, sf):
    return sampling.under_sample(labelled_orders(spark, sf), KEY, "label").select("o_orderkey", "label")


@query("class_weights", f"""WITH {RANKED} SELECT o_orderkey, label, {r('n / (2.0 * nc)')} AS weight FROM rk""")
def class_weight(spark, sf):
    return rounded(class_weights(labelled_orders(spark, sf), "label").select("o_orderkey", "label", "weight"))


DIMS = 64


def vectors(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.select("vec_id", F.when(F.col("label") == 3, 1).otherwise(0).alias("label"),
                    *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(DIMS)])


_DIST = "round(sqrt(list_sum(list_transform(range(1, 65), lambda i: (a.v[i] - b.v[i]) * (a.v[i] - b.v[i])))), 9)"
NEAR = f"""p AS (SELECT vec_id, CASE WHEN label = 3 THEN 1 ELSE 0 END AS label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
  mi AS (SELECT * FROM p WHERE label = 1),
  nn AS (SELECT a.vec_id, a.v, b.vec_id AS other, b.v AS w, {_DIST} AS d,
    row_number() OVER (PARTITION BY a.vec_id ORDER BY {_DIST}, b.vec_id) AS place
    FROM mi a JOIN mi b ON a.vec_id <> b.vec_id)"""


@query("nearest_neighbours", f"""WITH {NEAR} SELECT vec_id, CAST(place AS INTEGER) AS place, other, {r('d')} AS distance
  FROM nn WHERE place <= 5""")
def nearest_neighbours(spark, sf):
    small = vectors(spark, sf).where("label = 1")
    near = neighbours.nearest_neighbours(small, "vec_id", [f"e{i}" for i in range(DIMS)], 5)
    return rounded(near.select(F.col("key").alias("vec_id"), F.posexplode("neighbours").alias("p", "e")).select(
        "vec_id", (F.col("p") + 1).cast("int").alias("place"), F.col("e.key").alias("other"),
        F.col("e.distance").alias("distance")))


# the same in few dimensions, with blocks so small that cells are cut and excluded
_FLAT = "round(sqrt((a.p_size - b.p_size) * (a.p_size - b.p_size) + (a.p_retailprice - b.p_retailprice) * (a.p_retailprice - b.p_retailprice)), 9)"


@query("nearest_neighbours_cut", f"""WITH nn AS (SELECT a.p_partkey, b.p_partkey AS other, {_FLAT} AS d,
    row_number() OVER (PARTITION BY a.p_partkey ORDER BY {_FLAT}, b.p_partkey) AS place FROM part a JOIN part b ON a.p_partkey <> b.p_partkey)
  SELECT p_partkey, CAST(place AS INTEGER) AS place, other, {r('d')} AS distance FROM nn WHERE place <= 5""")
def nearest_neighbours_cut(spark, sf):
    near = neighbours.nearest_neighbours(table(spark, sf, "part"), "p_partkey", ["p_size", "p_retailprice"], 5, block=64)
    return rounded(near.select(F.col("key").alias("p_partkey"), F.posexplode("neighbours").alias("p", "e")).select(
        "p_partkey", (F.col("p") + 1).cast("int").alias("place"), F.col("e.key").alias("other"), F.col("e.distance").alias("distance")))


_MIX = "list_sum(list_transform(range(1, 65), lambda i: i * x[i]))"


@query("smote", f"""WITH {NEAR}, c AS (SELECT count(*) FILTER (label = 1) AS few, count(*) FILTER (label = 0) AS most FROM p),
  rk AS (SELECT vec_id, v, row_number() OVER (ORDER BY md5('42|' || CAST(vec_id AS VARCHAR))) AS rn FROM mi),
  cp AS (SELECT vec_id, v, CAST(t.j AS INTEGER) AS copy FROM rk, c, unnest(range(1, CAST((most - few) // few
     + CASE WHEN rn <= (most - few) % few THEN 1 ELSE 0 END AS BIGINT) + 1)) AS t(j)),
  h AS (SELECT *, md5('42|' || CAST(vec_id AS VARCHAR) || '|' || CAST(copy AS VARCHAR)) AS m FROM cp),
  ch AS (SELECT *, ('0x' || substr(m, 1, 8))::BIGINT % 5 + 1 AS pick,
     CAST(('0x' || substr(m, 9, 8))::BIGINT AS DOUBLE) / CAST(4294967296 AS DOUBLE) AS u FROM h),
  syn AS (SELECT ch.vec_id, ch.copy, list_transform(range(1, 65), lambda i: ch.v[i] + ch.u * (nn.w[i] - ch.v[i])) AS x
     FROM ch JOIN nn ON nn.vec_id = ch.vec_id AND nn.place = ch.pick),
  alls AS (SELECT vec_id, 0 AS copy, label, v AS x FROM p UNION ALL SELECT vec_id, copy, 1, x FROM syn)
  SELECT vec_id, CAST(copy AS INTEGER) AS copy, CAST(label AS INTEGER) AS label, {r('x[1]')} AS e0, {r('x[64]')} AS e63,
    {r(_MIX, 5)} AS mix FROM alls""")
def smote(spark, sf):
    cols = [f"e{i}" for i in range(DIMS)]
    made = neighbours.smote(vectors(spark, sf), "vec_id", "label", cols)
    mix = F.lit(0.0)
    for i, c in enumerate(cols):
        mix = mix + F.col(c) * F.lit(float(i + 1))
    return rounded(made.select("vec_id", "copy", "label", "e0", "e63", mix.alias("mix")), mix=5)
