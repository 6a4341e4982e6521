"""DuckDB SQL for each query."""

from __future__ import annotations

from .queries import CLASSES, DIGITS, HIDDEN, INPUTS

STEPS = "SELECT p_partkey, p_size, CAST(p_partkey % 3 + 1 AS INTEGER) AS timestep, CAST(round_even(log2(CAST(p_size AS DOUBLE)), 0) AS INTEGER) AS nhsteps FROM part"

NET = f"""
e AS (SELECT vec_id, CAST(i AS INTEGER) AS i, CAST(embedding[i + 1] AS DOUBLE) AS v FROM embeddings, range({INPUTS}) t(i)),
w1 AS (SELECT CAST(h AS INTEGER) AS h, CAST(i AS INTEGER) AS i, ((h * 31 + i * 17) % 101 - 50) / 500.0::DOUBLE AS w FROM range({HIDDEN}) a(h), range({INPUTS}) b(i)),
b1 AS (SELECT CAST(h AS INTEGER) AS h, ((h * 7) % 11 - 5) / 100.0::DOUBLE AS b FROM range({HIDDEN}) a(h)),
w2 AS (SELECT CAST(k AS INTEGER) AS k, CAST(h AS INTEGER) AS h, ((k * 13 + h * 29) % 97 - 48) / 400.0::DOUBLE AS w FROM range({CLASSES}) a(k), range({HIDDEN}) b(h)),
b2 AS (SELECT CAST(k AS INTEGER) AS k, ((k * 5) % 7 - 3) / 50.0::DOUBLE AS b FROM range({CLASSES}) a(k)),
hid AS (SELECT vec_id, w1.h AS h, sum(v * w) + any_value(b) AS v FROM e JOIN w1 USING (i) JOIN b1 USING (h) GROUP BY vec_id, w1.h),
act AS (SELECT vec_id, h, greatest(v, 0.0::DOUBLE) AS v FROM hid),
z AS (SELECT vec_id, w2.k AS k, sum(v * w) + any_value(b) AS z FROM act JOIN w2 USING (h) JOIN b2 USING (k) GROUP BY vec_id, w2.k),
x AS (SELECT vec_id, k, exp(z - max(z) OVER (PARTITION BY vec_id)) AS x FROM z),
p AS (SELECT vec_id, k, x / sum(x) OVER (PARTITION BY vec_id) AS p FROM x)
"""

FORWARD = f"WITH {NET} SELECT vec_id, k AS cls, round(p, {DIGITS}) AS p FROM p"

POINTS = "SELECT vec_id, label, embedding, CAST(vec_id % 3 + 1 AS INTEGER) AS timestep, CAST(row_number() OVER (PARTITION BY vec_id % 3 ORDER BY vec_id) - 1 AS INTEGER) AS x, row_number() OVER (ORDER BY vec_id % 3, vec_id) - 1 AS row FROM embeddings"
PARTS = "SELECT p_size, p_retailprice, CAST(p_partkey % 3 + 1 AS INTEGER) AS timestep, CAST(row_number() OVER (PARTITION BY p_partkey % 3 ORDER BY p_partkey) - 1 AS INTEGER) AS x, row_number() OVER (ORDER BY p_partkey % 3, p_partkey) - 1 AS row, CAST(round_even(log2(CAST(p_size AS DOUBLE)), 0) AS INTEGER) AS nhsteps FROM part"

SQL = {
    "loader_targets": f"WITH s AS ({PARTS}), m AS (SELECT max(nhsteps) AS m FROM s) SELECT timestep, x, nhsteps, repeat('0', nhsteps) || '1' || repeat('0', m - nhsteps) AS target, m AS max_nhsteps FROM s, m",
    "loader_prefixes": f"SELECT CAST(n AS INTEGER) AS num_timesteps, count(*) AS n_rows, max(nhsteps) AS max_nhsteps FROM ({PARTS}) JOIN range(1, 4) t(n) ON timestep <= n GROUP BY n",
    "loader_features": "SELECT timestep, x, CAST(label AS FLOAT) AS label, " + ", ".join(f"embedding[{j + 1}] AS embedding_{j}" for j in range(INPUTS)) + f" FROM ({POINTS})",
    "loader_features_double": f"SELECT timestep, x, CAST(CAST(label AS FLOAT) AS DOUBLE) AS label FROM ({POINTS})",
    "loader_feature_names": "WITH n AS (SELECT max(len(embedding)) AS n FROM embeddings) SELECT 0 AS pos, 'label' AS name UNION ALL SELECT CAST(j + 1 AS INTEGER), 'embedding_' || j FROM range((SELECT n FROM n)) t(j)",
    "loader_aligned": f"SELECT timestep, x, CAST(label % 5 AS INTEGER) AS nhsteps, CAST(label AS FLOAT) AS label FROM ({POINTS})",
    "source_rows_1d": f"SELECT 'ncsteps' AS variable, timestep, x, CAST(p_size AS FLOAT) AS value, row FROM ({PARTS})",
    "source_rows_2d": f"SELECT timestep, x, CAST(i AS INTEGER) AS component, embedding[i + 1] AS value, row FROM ({POINTS}), range({INPUTS}) t(i)",
    "source_files": f"WITH p AS ({POINTS}), q AS ({PARTS}), s AS (SELECT 'embedding' AS variable, {INPUTS} || 'x' || count(*) AS shape FROM p WHERE timestep = 1 UNION ALL SELECT 'label', CAST(count(*) AS VARCHAR) FROM p WHERE timestep = 1 UNION ALL SELECT 'ncsteps', CAST(count(*) AS VARCHAR) FROM q WHERE timestep = 1) SELECT variable, CAST(t AS INTEGER) AS timestep, variable || '_' || t || '.cdl' AS file, shape FROM s, range(1, 3) r(t)",
    "loader_price_double": f"SELECT timestep, x, CAST(CAST(p_retailprice AS FLOAT) AS DOUBLE) AS price FROM ({PARTS})",
    "grid_source_1d": f"SELECT 'ncsteps' AS variable, timestep, x, CAST(p_size AS FLOAT) AS value, row FROM ({PARTS})",
    "grid_source_2d": f"SELECT timestep, x, CAST(i AS INTEGER) AS component, embedding[i + 1] AS value, row FROM ({POINTS}), range({INPUTS}) t(i)",
    "grid_pushdown": f"SELECT timestep, x, CAST(i AS INTEGER) AS component, embedding[i + 1] AS value FROM ({POINTS}), range({INPUTS}) t(i) WHERE timestep = 2",
    "stream_prefixes": f"SELECT CAST(n AS INTEGER) AS num_timesteps, count(*) AS n_rows, max(nhsteps) AS max_nhsteps FROM ({PARTS}) JOIN range(1, 4) t(n) ON timestep <= n GROUP BY n",
    "onehot_vector": f"WITH s AS ({STEPS}), m AS (SELECT max(nhsteps) AS m FROM s) SELECT p_partkey, repeat('0', nhsteps) || '1' || repeat('0', m - nhsteps) AS target FROM s, m",
    "feature_vector": "SELECT vec_id, CAST(label AS FLOAT) AS label, " + ", ".join(f"embedding[{j + 1}] AS embedding_{j}" for j in range(INPUTS)) + " FROM embeddings",
    "fcnn_native": FORWARD,
    "fcnn_pipeline": FORWARD,
    "fcnn_from_table": FORWARD,
    "nhsteps": f"SELECT p_partkey, p_size, nhsteps FROM ({STEPS})",
    "max_nhsteps": f"SELECT max(nhsteps) AS max_nhsteps FROM ({STEPS})",
    "max_nhsteps_by_prefix": f"SELECT CAST(n AS INTEGER) AS num_timesteps, max(nhsteps) AS max_nhsteps FROM ({STEPS}) JOIN range(1, 4) t(n) ON timestep <= n GROUP BY n",
    "class_histogram_dense": "WITH s AS (SELECT CAST(round_even(log2(CAST(p_size AS DOUBLE) * p_size), 0) AS INTEGER) AS nhsteps FROM part) SELECT CAST(j AS INTEGER) AS cls, count(nhsteps) AS n FROM range((SELECT max(nhsteps) + 1 FROM s)) t(j) LEFT JOIN s ON s.nhsteps = j GROUP BY j",
    "onehot_long": f"WITH s AS ({STEPS}) SELECT p_partkey, CAST(j AS INTEGER) AS cls, CAST(nhsteps = j AS INTEGER) AS target FROM s, range((SELECT max(nhsteps) + 1 FROM s)) t(j)",
    "onehot_wide": "SELECT p_partkey, " + ", ".join(f"CAST(nhsteps = {j} AS INTEGER) AS target_{j}" for j in range(7)) + f" FROM ({STEPS})",
    "onehot_array": f"WITH s AS ({STEPS}), m AS (SELECT max(nhsteps) AS m FROM s) SELECT p_partkey, repeat('0', nhsteps) || '1' || repeat('0', m - nhsteps) AS target FROM s, m",
    "timestep_concat": "SELECT p_partkey, CAST(p_partkey % 3 + 1 AS INTEGER) AS timestep, CAST(row_number() OVER (PARTITION BY p_partkey % 3 ORDER BY p_partkey) - 1 AS INTEGER) AS x, row_number() OVER (ORDER BY p_partkey % 3, p_partkey) - 1 AS row FROM part",
    "float32_cast": "SELECT p_partkey, CAST(CAST(p_retailprice AS FLOAT) AS DOUBLE) AS price FROM part",
    "slice_unpack": "SELECT vec_id, CAST(i AS INTEGER) AS component, embedding[i + 1] AS value FROM embeddings, range(len(embedding)) t(i)",
    "feature_registry": "WITH n AS (SELECT max(len(embedding)) AS n FROM embeddings) SELECT 0 AS pos, 'p_retailprice' AS name UNION ALL SELECT CAST(j + 1 AS INTEGER), 'embedding_' || j FROM range((SELECT n FROM n)) t(j)",
    "feature_stack": "SELECT vec_id, CAST(label AS FLOAT) AS label, " + ", ".join(f"embedding[{j + 1}] AS embedding_{j}" for j in range(INPUTS)) + " FROM embeddings",
    "feature_stack_long": "SELECT vec_id, CAST(label AS FLOAT) AS label, " + ", ".join(f"embedding[{j + 1}] AS embedding_{j}" for j in range(INPUTS)) + " FROM embeddings",
    "dense_hidden": f"WITH {NET} SELECT vec_id, h AS unit, round(v, {DIGITS}) AS v FROM hid",
    "relu_hidden": f"WITH {NET} SELECT vec_id, h AS unit, round(v, {DIGITS}) AS v FROM act",
    "dense_output": f"WITH {NET} SELECT vec_id, k AS cls, round(z, {DIGITS}) AS z FROM z",
    "softmax": FORWARD,
    "fcnn_forward": FORWARD,
    "fcnn_relational": FORWARD,
    "prob_sum": f"WITH {NET} SELECT vec_id, round(sum(p), 9) AS total FROM p GROUP BY vec_id",
    "predicted_class": f"WITH {NET} SELECT vec_id, CAST(arg_max(k, p) AS INTEGER) AS cls, pow(0.5, arg_max(k, p)) AS dt FROM p GROUP BY vec_id",
}
