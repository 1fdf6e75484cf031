"""Feature libraries, regressions and model selection on line items, embeddings and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import library as L
from ..operators import records as X
from ..operators import regression as G
from ..operators import selection as M
from .inputs import table

QUERIES, SQL = {}, {}


def query(sql: str = ""):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def rounded(df, digits=6):
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else c for c, t in df.dtypes])


def _items(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", (F.col("l_quantity") / 50).alias("q"), F.col("l_discount").alias("d"), F.col("l_tax").alias("v"), (F.col("l_extendedprice") / 100000).alias("y"))


ITEMS = """it AS (SELECT l_orderkey, l_linenumber, l_returnflag, l_quantity / 50 AS q, l_discount AS d, l_tax AS v, l_extendedprice / 100000 AS y FROM lineitem)"""
_TERMS = L.monomials(["q", "d", "v"], 3)
_PRODUCTS = ", ".join(f"round({' * '.join(t) if t else '1.0'}, 6)::DOUBLE AS f{i}" for i, t in enumerate(_TERMS))


@query(f"WITH {ITEMS} SELECT l_orderkey, l_linenumber, {_PRODUCTS} FROM it")
def lib_polynomial(spark, sf_dir):
    return rounded(L.polynomial_library(_items(spark, sf_dir), ["q", "d", "v"], 3, ["l_orderkey", "l_linenumber"]))


_QUAD = ", ".join(f"round({' * '.join(t) if t else '1.0'}, 6)::DOUBLE AS z{i}" for i, t in enumerate(L.monomials(["q", "d"], 2)))


@query(f"WITH {ITEMS} SELECT l_orderkey, l_linenumber, {_QUAD} FROM it")
def lib_quadratic(spark, sf_dir):
    return rounded(L.quadratic_library(_items(spark, sf_dir), ["q", "d"], ["l_orderkey", "l_linenumber"]))


CENTERS = """ce AS (SELECT vec_id, embedding FROM embeddings ORDER BY vec_id LIMIT 10)"""


def _centers(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").orderBy("vec_id").limit(10)  # a model's centers: the first ten by definition


@query(f"""WITH {CENTERS}, d AS (SELECT a.vec_id AS a, b.vec_id AS b, list_sum([(x[1] - x[2])::DOUBLE * (x[1] - x[2])::DOUBLE FOR x IN list_zip(a.embedding::DOUBLE[], b.embedding::DOUBLE[])]) AS d2 FROM ce a JOIN ce b ON a.vec_id != b.vec_id)
SELECT round(1.0 / greatest(median(d2), 1e-12), 6) AS gamma FROM d WHERE d2 > 0""")
def lib_rbf_fit(spark, sf_dir):
    return rounded(L.rbf_gamma(_centers(spark, sf_dir), "vec_id", "embedding"))


@query(f"""WITH {CENTERS}, c2 AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS c, embedding AS e FROM ce), d AS (SELECT v.vec_id, c, list_sum([(x[1] - x[2])::DOUBLE * (x[1] - x[2])::DOUBLE FOR x IN list_zip(v.embedding::DOUBLE[], c2.e::DOUBLE[])]) AS d2 FROM embeddings v, c2)
SELECT vec_id, c::INT AS c, round(exp(-0.05 * d2), 6) AS feature FROM d""")
def lib_rbf_lift(spark, sf_dir):
    centers = [list(map(float, r["embedding"])) for r in _centers(spark, sf_dir).collect()]
    lifted = L.rbf_lift(table(spark, sf_dir, "embeddings"), centers, 0.05, "embedding")
    radial = F.slice("lifted", F.size("embedding") + 2, len(centers))
    return rounded(lifted.select("vec_id", F.posexplode(radial).alias("c", "feature")))


_GRAM = " UNION ALL ".join(f"SELECT l_returnflag, {i} AS i, {j} AS j, round(sum({a} * {b}), 4) AS value FROM it GROUP BY 1" for i, a in enumerate("qdvy") for j, b in enumerate("qdvy") if i <= j)


@query(f"WITH {ITEMS} {_GRAM}")
def gram_matrix(spark, sf_dir):
    g = G.gram(_items(spark, sf_dir), ["q", "d", "v"], ["y"], ["l_returnflag"])
    return rounded(G.gram_long(g, 4, ["l_returnflag"]), 4)


@query(f"WITH {ITEMS} SELECT l_returnflag, round(sqrt(sum(q * q)), 4) AS norm_q, round(sqrt(sum(d * d)), 4) AS norm_d FROM it GROUP BY 1")
def column_norms(spark, sf_dir):
    return rounded(G.column_norms(_items(spark, sf_dir), ["q", "d"], ["l_returnflag"]), 4)


_SUMS = "sum(q * q) AS aa, sum(q * d) AS ab, sum(d * d) AS bb, sum(q * y) AS ay, sum(d * y) AS bdy, count(*) AS n"


@query(f"WITH {ITEMS}, s AS (SELECT l_returnflag, {_SUMS} FROM it GROUP BY 1) SELECT l_returnflag, n, round(((bb + 1e-8) * ay - ab * bdy) / ((aa + 1e-8) * (bb + 1e-8) - ab * ab), 6) AS coef_a, round(((aa + 1e-8) * bdy - ab * ay) / ((aa + 1e-8) * (bb + 1e-8) - ab * ab), 6) AS coef_b FROM s")
def ridge_quantity_discount(spark, sf_dir):
    return rounded(G.ridge_two(_items(spark, sf_dir), "q", "d", "y", ["l_returnflag"]))


@query(f"""WITH {ITEMS}, s AS (SELECT l_returnflag, {_SUMS} FROM it GROUP BY 1), m AS (SELECT *, ab / sqrt(aa * bb) AS r, ay / sqrt(aa) AS ra, bdy / sqrt(bb) AS rb FROM s),
f AS (SELECT *, ((1 + 1e-8) * ra - r * rb) / ((1 + 1e-8) * (1 + 1e-8) - r * r) / sqrt(aa) AS a, ((1 + 1e-8) * rb - r * ra) / ((1 + 1e-8) * (1 + 1e-8) - r * r) / sqrt(bb) AS b, ra / (1 + 1e-8) / sqrt(aa) AS oa, rb / (1 + 1e-8) / sqrt(bb) AS ob FROM m)
SELECT l_returnflag, n, round(CASE WHEN abs(a) >= 0.1 AND abs(b) >= 0.1 THEN a WHEN abs(a) >= 0.1 AND abs(oa) >= 0.1 THEN oa ELSE 0 END, 6) AS coef_a, round(CASE WHEN abs(a) >= 0.1 AND abs(b) >= 0.1 THEN b WHEN abs(b) >= 0.1 AND NOT abs(a) >= 0.1 AND abs(ob) >= 0.1 THEN ob ELSE 0 END, 6) AS coef_b FROM f""")
def stlsq_quantity_price(spark, sf_dir):
    return rounded(G.stlsq_two(_items(spark, sf_dir), "q", "d", "y", 0.1, ["l_returnflag"]))


def _path(spark, sf_dir):
    """Threshold paths of price on all cubic terms of quantity, discount and tax, a group for each return flag."""
    features = [f"f{i}" for i in range(len(_TERMS))]
    lib = L.polynomial_library(_items(spark, sf_dir), ["q", "d", "v"], 3, ["l_returnflag", "y"])
    g = G.gram_arrays(lib, features, ["y"], ["l_returnflag"])
    return G.stlsq_path(g, features, ["y"], [0.0, 0.01, 0.03, 0.1, 0.3, 1.0, 3.0], ["l_returnflag"])


@query()
def stlsq_path_cubic(spark, sf_dir):
    return rounded(_path(spark, sf_dir), 5)


@query()
def candidate_path_cubic(spark, sf_dir):
    c = M.candidate_path(_path(spark, sf_dir), ["l_returnflag"])
    return rounded(M.information_criteria(c, len(_TERMS)), 4)


@query()
def select_models_cubic(spark, sf_dir):
    c = M.information_criteria(M.candidate_path(_path(spark, sf_dir), ["l_returnflag"]), len(_TERMS))
    return rounded(M.select_models(c.withColumnRenamed("threshold_index", "candidate_id"), ["l_returnflag", "equation"]), 4)


COEFS = """co AS (SELECT lang, source, avg(quality) - 0.85 AS coef, avg(toxic) AS true_coef FROM documents JOIN labels USING (doc_id) GROUP BY ALL)"""


def _coefs(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source").join(table(spark, sf_dir, "labels"), "doc_id")
    return d.groupBy("lang", "source").agg((F.avg("quality") - 0.85).alias("coef"), F.avg("toxic").alias("true_coef"))


@query(f"""WITH {COEFS}, c AS (SELECT lang, abs(coef) > 1e-10 AS p, abs(true_coef) > 1e-10 AS w, coef, true_coef FROM co), s AS (SELECT lang, sum(CASE WHEN p AND w THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN p AND NOT w THEN 1 ELSE 0 END) AS fp, sum(CASE WHEN w AND NOT p THEN 1 ELSE 0 END) AS fn, bool_and(p = w) AS exact_support,
sqrt(sum(pow(coef - true_coef, 2))) / greatest(sqrt(sum(true_coef * true_coef)), 1e-12) AS e FROM c GROUP BY 1), f AS (SELECT *, CASE WHEN tp + fp + fn = 0 THEN 1.0 ELSE 2.0 * tp / greatest(2.0 * tp + fp + fn, 1e-12) END::DOUBLE AS f1 FROM s)
SELECT lang, round(f1, 6) AS support_f1, round(e, 6) AS coef_error, exact_support, round(f1 / (1 + e), 6) AS practical_score FROM f""")
def metric_coefficients(spark, sf_dir):
    return rounded(G.coefficient_scores(_coefs(spark, sf_dir), ["lang"]))


CANDIDATES = """ca0 AS (SELECT l_returnflag AS g, (l_linenumber)::INT AS support_size, (l_discount * 100)::INT AS candidate_id, sum(l_tax * l_tax) / 10 AS rss, count(*) AS n FROM lineitem GROUP BY ALL),
lc AS (SELECT *, lgamma(11) - lgamma(support_size + 1) - lgamma(11 - support_size) AS lc FROM ca0),
ca AS (SELECT g, support_size, candidate_id, rss, n, greatest(n, 2) * ln(greatest(rss, 1e-12) / greatest(n, 2)) + support_size * ln(greatest(n, 2)) AS bic, greatest(n, 2) * ln(greatest(rss, 1e-12) / greatest(n, 2)) + support_size * ln(greatest(n, 2)) + 2 * lc AS ebic FROM lc)"""


def _candidates(spark, sf_dir):
    """Candidates made of line items: size from the line number, residuals from the tax."""
    li = table(spark, sf_dir, "lineitem")
    g = li.groupBy(F.col("l_returnflag").alias("g"), F.col("l_linenumber").cast("int").alias("support_size"), F.round(F.col("l_discount") * 100).cast("int").alias("candidate_id"))
    return M.information_criteria(g.agg((F.sum(F.col("l_tax") * F.col("l_tax")) / 10).alias("rss"), F.count("*").alias("n")), 10)


@query(f"WITH {CANDIDATES} SELECT g, support_size, candidate_id, round(bic, 4) AS bic, round(ebic, 4) AS ebic FROM ca")
def ic_bic_ebic(spark, sf_dir):
    return rounded(_candidates(spark, sf_dir).select("g", "support_size", "candidate_id", "bic", "ebic"), 4)


FRONT = """fr AS (SELECT *, ebic - min(ebic) OVER (PARTITION BY g) AS delta FROM (SELECT * FROM ca WHERE support_size > 0 QUALIFY row_number() OVER (PARTITION BY g, support_size ORDER BY ebic, candidate_id) = 1))"""


@query(f"WITH {CANDIDATES}, {FRONT} SELECT g, support_size, candidate_id, round(ebic, 4) AS ebic, round(delta, 4) AS delta_from_best FROM fr")
def pareto_front(spark, sf_dir):
    return rounded(M.pareto_front(_candidates(spark, sf_dir), ["g"]).select("g", "support_size", "candidate_id", "ebic", "delta_from_best"), 4)


@query(f"""WITH {CANDIDATES}, {FRONT}, y AS (SELECT *, max(ebic) OVER w - ebic AS y, count(*) OVER w AS n2, min(support_size) OVER w AS x0, max(support_size) OVER w AS x1 FROM fr WINDOW w AS (PARTITION BY g)),
z AS (SELECT *, greatest(max(y) OVER w - min(y) OVER w, 1e-12) AS span, arg_min(y, support_size) OVER w AS y0, arg_max(y, support_size) OVER w AS y1 FROM y WINDOW w AS (PARTITION BY g)),
d AS (SELECT *, round(abs((y - y0 - (y1 - y0) * (support_size - x0) / greatest(x1 - x0, 1)::DOUBLE) / span), 9) AS d FROM z), f AS (SELECT *, n2 <= 2 OR max(d) OVER (PARTITION BY g) <= 0 AS flat FROM d)
SELECT g, support_size, candidate_id, CASE WHEN n2 = 1 THEN 'single' WHEN flat THEN 'fallback_min_ebic' ELSE 'elbow_ebic' END AS selection_rule FROM f QUALIFY row_number() OVER (PARTITION BY g ORDER BY CASE WHEN flat THEN ebic ELSE -d END, support_size) = 1""")
def elbow_chord(spark, sf_dir):
    f = M.pareto_front(_candidates(spark, sf_dir), ["g"])
    return M.chord_elbow(f, ["g"]).select("g", "support_size", "candidate_id", "selection_rule")


@query("""WITH e AS (SELECT vec_id, unnest(embedding::DOUBLE[]) AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings) SELECT i::INT AS i, round(avg(v), 6) AS mean, round(var_pop(v), 6) AS variance FROM e GROUP BY 1""")
def pod_mean_variance(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.posexplode("embedding").alias("i", "v"))
    return rounded(e.groupBy("i").agg(F.avg(F.col("v").cast("double")).alias("mean"), F.var_pop(F.col("v").cast("double")).alias("variance")))


@query(f"""WITH {CENTERS} SELECT round(1.0 / greatest(var_pop(v) + 1e-12, 1e-12), 5) AS gamma FROM (SELECT unnest(embedding::DOUBLE[]) AS v FROM ce WHERE vec_id = (SELECT min(vec_id) FROM ce))""")
def lib_rbf_fit_single(spark, sf_dir):
    """The width for a single center, the first by definition."""
    return rounded(L.rbf_gamma(table(spark, sf_dir, "embeddings").orderBy("vec_id").limit(1), "vec_id", "embedding"), 5)


@query(f"""WITH {COEFS} SELECT lang, source, round(coef, 6) AS coef, round(true_coef, 6) AS true_coef FROM co WHERE abs(coef) > 1e-12 OR abs(true_coef) > 1e-12""")
def flt_active_coefficients(spark, sf_dir):
    return rounded(X.active_coefficients(_coefs(spark, sf_dir)))


@query(f"""WITH {COEFS} SELECT lang, (row_number() OVER (PARTITION BY lang ORDER BY source) - 1)::INT AS term, round(coef, 6) AS coef FROM co""")
def coefficients_json_round_trip(spark, sf_dir):
    """Coefficients of a model to a JSON list and back."""
    packed = X.coefficients_to_json(_coefs(spark, sf_dir), ["lang"], order="source")
    return rounded(X.coefficients_from_json(packed).select("lang", "term", "coef"))


THRESHOLDS = (0.01, 0.1, 0.3, 1.0, 2.0)


@query(f"""WITH {ITEMS}, s AS (SELECT l_returnflag, {_SUMS} FROM it GROUP BY 1), m AS (SELECT *, ab / sqrt(aa * bb) AS r, ay / sqrt(aa) AS ra, bdy / sqrt(bb) AS rb FROM s),
f AS (SELECT *, ((1 + 1e-8) * ra - r * rb) / ((1 + 1e-8) * (1 + 1e-8) - r * r) / sqrt(aa) AS a, ((1 + 1e-8) * rb - r * ra) / ((1 + 1e-8) * (1 + 1e-8) - r * r) / sqrt(bb) AS b, ra / (1 + 1e-8) / sqrt(aa) AS oa, rb / (1 + 1e-8) / sqrt(bb) AS ob FROM m),
h AS (SELECT *, list_position({list(THRESHOLDS)}, h) AS i FROM f, (SELECT unnest({list(THRESHOLDS)}::DOUBLE[]) AS h)),
c AS (SELECT l_returnflag, h, i, CASE WHEN abs(a) >= h AND abs(b) >= h THEN a WHEN abs(a) >= h AND abs(oa) >= h THEN oa ELSE 0 END AS ca, CASE WHEN abs(a) >= h AND abs(b) >= h THEN b WHEN abs(b) >= h AND NOT abs(a) >= h AND abs(ob) >= h THEN ob ELSE 0 END AS cb FROM h),
e AS (SELECT *, (abs(ca) > 1e-10)::INT AS p, (abs(cb) > 1e-10)::INT AS q, sqrt(pow(ca - 0.75, 2) + cb * cb) / 0.75 AS err FROM c), g AS (SELECT *, 2.0 * p / greatest(2.0 * p + q + (1 - p), 1e-12)::DOUBLE AS f1 FROM e)
SELECT l_returnflag, h AS threshold, round(f1, 6) AS support_f1, round(err, 6) AS coef_error, round(f1 / (1 + err), 6) AS practical_score, p = 1 AND q = 0 AS exact_support
FROM g QUALIFY row_number() OVER (PARTITION BY l_returnflag ORDER BY f1 / (1 + err) DESC, f1 DESC, err, i) = 1""")
def fit_best_threshold(spark, sf_dir):
    """Of the thresholded fits of price on quantity and discount the one nearest to a known law."""
    fits = G.stlsq_two(_items(spark, sf_dir), "q", "d", "y", list(THRESHOLDS), ["l_returnflag"])
    path = fits.select("l_returnflag", "threshold_index", "threshold", F.posexplode(F.array("coef_a", "coef_b")).alias("term", "coef"))
    truth = X.parameter_grid(spark, t=[0]).select(F.posexplode(F.array(F.lit(0.75), F.lit(0.0))).alias("term", "true_coef"))
    return rounded(G.best_threshold(path, truth, ["l_returnflag"]))


# --- models of three terms, which SQL can follow through all passes --------------------------------------

THREE = (0.0, 0.05, 0.3, 0.6, 0.9)


def _minor(on: list[int]) -> str:
    """Solutions of the scaled normal equations with these of the three columns, by Cramer's rule, as SQL for x0, x1, x2."""
    m = lambda i, j: f"(m{min(i, j)}{max(i, j)}{' + 1e-8' if i == j else ''})"
    det = {1: lambda a: a[0][0], 2: lambda a: f"({a[0][0]} * {a[1][1]} - {a[0][1]} * {a[1][0]})"}
    det[3] = lambda a: "(" + " + ".join(f"{a[0][c]} * ({a[1][(c + 1) % 3]} * {a[2][(c + 2) % 3]} - {a[1][(c + 2) % 3]} * {a[2][(c + 1) % 3]})" for c in range(3)) + ")"
    whole = [[m(i, j) for j in on] for i in on]
    found = {k: f"{det[len(on)]([[f'r{i}' if j == k else m(i, j) for j in on] for i in on])} / {det[len(on)](whole)} / n{k}" for k in on}
    return ", ".join(f"{found.get(k, '0.0')} AS x{k}" for k in range(3))


_COLS = "qdv"
_ABC = ", ".join([f"sum({a} * {b}) AS a{i}{j}" for i, a in enumerate(_COLS) for j, b in enumerate(_COLS) if i <= j] + [f"sum({a} * y) AS b{i}" for i, a in enumerate(_COLS)])
_SCALED = ", ".join([f"a{i}{j} / sqrt(a{i}{i} * a{j}{j}) AS m{i}{j}" for i in range(3) for j in range(i, 3)] + [f"b{i} / sqrt(a{i}{i}) AS r{i}, sqrt(a{i}{i}) AS n{i}" for i in range(3)])
_SUBSETS = " UNION ALL ".join(f"SELECT l_returnflag, {mask} AS mask, {_minor([i for i in range(3) if mask >> i & 1])} FROM sc" for mask in range(1, 8)) + " UNION ALL SELECT l_returnflag, 0, 0.0, 0.0, 0.0 FROM sc"
_NEXT = " + ".join(f"(CASE WHEN p.mask & {1 << i} > 0 AND abs(x{i}) >= h THEN {1 << i} ELSE 0 END)" for i in range(3))
#: A pass drops a term or is the last, so that the fourth leaves what all twelve leave.
_PASSES = ", ".join(f"p{k} AS (SELECT p.l_returnflag, h, i, {_NEXT} AS mask FROM p{k - 1} p JOIN sb USING (l_returnflag, mask))" for k in range(1, 5))
PATH3 = f"""{ITEMS}, gs AS (SELECT l_returnflag, count(*) AS n, sum(y * y) AS yy, {_ABC} FROM it GROUP BY 1), sc AS (SELECT l_returnflag, {_SCALED} FROM gs), sb AS ({_SUBSETS}),
p0 AS (SELECT l_returnflag, h, i, 7 AS mask FROM gs, (SELECT unnest({list(THREE)}::DOUBLE[]) AS h, unnest(range(0, {len(THREE)})) AS i)), {_PASSES},
pa AS (SELECT l_returnflag, i, h, mask, n, x0, x1, x2, greatest(0, yy - 2 * (x0 * b0 + x1 * b1 + x2 * b2) + x0 * x0 * a00 + x1 * x1 * a11 + x2 * x2 * a22 + 2 * (x0 * x1 * a01 + x0 * x2 * a02 + x1 * x2 * a12)) AS rss
 FROM p4 JOIN sb USING (l_returnflag, mask) JOIN gs USING (l_returnflag))"""


def _path3(spark, sf_dir):
    g = G.gram(_items(spark, sf_dir), list(_COLS), ["y"], ["l_returnflag"])
    return G.stlsq_path(g, list(_COLS), ["y"], list(THREE), ["l_returnflag"])


@query(f"""WITH {PATH3} SELECT l_returnflag, i::INT AS threshold_index, h AS threshold, 'y' AS equation, unnest([0, 1, 2]) AS term, unnest(['q', 'd', 'v']) AS feature, round(unnest([x0, x1, x2]), 6) AS coef, round(rss, 4) AS rss, n, 'ok' AS status FROM pa""")
def stlsq_path_three(spark, sf_dir):
    p = _path3(spark, sf_dir)
    return p.withColumn("coef", F.round("coef", 6)).withColumn("rss", F.round("rss", 4))


CANDIDATES3 = f"""{PATH3}, su AS (SELECT *, (abs(x0) > 1e-10)::INT + (abs(x1) > 1e-10)::INT + (abs(x2) > 1e-10)::INT AS k, concat_ws(';', CASE WHEN abs(x0) > 1e-10 THEN '0' END, CASE WHEN abs(x1) > 1e-10 THEN '1' END, CASE WHEN abs(x2) > 1e-10 THEN '2' END) AS terms FROM pa),
dd AS (SELECT *, min(rss) OVER (PARTITION BY l_returnflag, terms ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM su),
cp AS (SELECT *, n * ln(greatest(rss, 1e-12) / n) + k * ln(n) AS bic, CASE k WHEN 1 THEN ln(3) WHEN 2 THEN ln(3) ELSE 0 END AS lc FROM dd WHERE best IS NULL OR rss < best - 1e-12)"""


@query(f"WITH {CANDIDATES3} SELECT l_returnflag, i::INT AS threshold_index, k AS support_size, terms AS active_terms, round(rss, 4) AS rss, round(bic, 4) AS bic, round(bic + 2 * lc, 4) AS ebic FROM cp")
def candidate_path_three(spark, sf_dir):
    c = M.information_criteria(M.candidate_path(_path3(spark, sf_dir), ["l_returnflag"]), 3)
    return rounded(c.select("l_returnflag", "threshold_index", F.col("support_size").cast("int").alias("support_size"), "active_terms", "rss", "bic", "ebic"), 4)


@query(f"""WITH {CANDIDATES}, {FRONT}, kn AS (SELECT *, max(ebic) OVER w - ebic AS y, count(*) OVER w AS m, min(support_size) OVER w AS x0, max(support_size) OVER w AS x1 FROM fr WINDOW w AS (PARTITION BY g)),
kd AS (SELECT *, CASE WHEN m >= 3 AND x1 > x0 AND max(y) OVER (PARTITION BY g) > min(y) OVER (PARTITION BY g) THEN (y - min(y) OVER (PARTITION BY g)) / (max(y) OVER (PARTITION BY g) - min(y) OVER (PARTITION BY g)) - (support_size - x0)::DOUBLE / (x1 - x0) END AS d FROM kn),
kp AS (SELECT *, coalesce(d >= lag(d) OVER w AND d >= lead(d) OVER w, false) AS peak FROM kd WINDOW w AS (PARTITION BY g ORDER BY support_size)), kq AS (SELECT *, sum(peak::INT) OVER (PARTITION BY g ORDER BY support_size) AS after FROM kp),
kf AS (SELECT *, peak AND coalesce(min(CASE WHEN NOT peak THEN d END) OVER (PARTITION BY g, after) < d - 1.0 / (m - 1), false) AS falls FROM kq), kk AS (SELECT *, min(CASE WHEN falls THEN support_size END) OVER (PARTITION BY g) AS knee FROM kf),
ch AS (SELECT *, arg_min(y, support_size) OVER w AS y0, arg_max(y, support_size) OVER w AS y1, greatest(max(y) OVER w - min(y) OVER w, 1e-12) AS span FROM kk WINDOW w AS (PARTITION BY g)),
cd AS (SELECT *, round(abs((y - y0 - (y1 - y0) * (support_size - x0) / greatest(x1 - x0, 1)::DOUBLE) / span), 9) AS off FROM ch), cf AS (SELECT *, m <= 2 OR max(off) OVER (PARTITION BY g) <= 0 AS flat FROM cd),
se AS (SELECT *, CASE WHEN knee IS NOT NULL OR NOT flat THEN 'elbow_ebic' WHEN m = 1 THEN 'single' ELSE 'fallback_min_ebic' END AS selection_rule FROM cf QUALIFY CASE WHEN knee IS NOT NULL THEN support_size = knee ELSE row_number() OVER (PARTITION BY g ORDER BY CASE WHEN flat THEN ebic ELSE -off END, support_size) = 1 END)
SELECT g, support_size, candidate_id, round(ebic, 4) AS ebic, round(delta, 4) AS delta_from_best, selection_rule FROM se""")
def select_models_knee(spark, sf_dir):
    s = M.select_models(_candidates(spark, sf_dir), ["g"])
    return rounded(s.select("g", "support_size", "candidate_id", "ebic", "delta_from_best", "selection_rule"), 4)
