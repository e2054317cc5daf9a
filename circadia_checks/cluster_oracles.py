"""k-means as recursive SQL for DuckDB: the rounds of every fit as one recursion over lists of centres."""

from __future__ import annotations

from collections.abc import Sequence

UNIT = 4294967296
TOLERANCE = 0.0001
START_ROWS = 2048
SEED = 62

Steps = list[tuple[str, str]]


def _distance(center: str, x: str, width: int) -> str:
    return " + ".join(f"({center}[{j}] - {x}[{j}]) ** 2" for j in range(1, width + 1))


def _rows(points: str, columns: Sequence[str]) -> Steps:
    """Distinct fixed-point rows of each part with their number, in the order that starts are chosen in."""
    units = ", ".join(f"CAST(round({c} * {UNIT}.0) AS BIGINT)" for c in columns)
    known = " AND ".join(f"{c} IS NOT NULL" for c in columns)
    return [
        ("km_points", f"SELECT part, [{units}] AS u FROM ({points}) WHERE {known}"),
        ("km_rows", f"""SELECT part, u, list_transform(u, lambda v: v / {UNIT}.0) AS x, count(*) AS n,
  row_number() OVER (PARTITION BY part ORDER BY md5('{SEED}|' || array_to_string(u, '|')), u) AS i FROM km_points GROUP BY part, u"""),
    ]


def _round(state: str, going: str, width: int, keep: str) -> str:
    """One pass: per state the moved centres, the sum of squares and the row that a further cluster would start from."""
    mean = ", ".join(f"floor(CAST(sum(n * u[{j}]) AS DOUBLE) / CAST(sum(n) AS DOUBLE) + 0.5) / {UNIT}.0" for j in range(1, width + 1))
    far = " OR ".join(f"abs(p.a[{j}] - p.b[{j}]) > {TOLERANCE}" for j in range(1, width + 1))
    return f"""
SELECT *, len(list_filter(list_zip_pairs, lambda p: {far})) > 0 AS far FROM (
 SELECT *, list_transform(range(1, len(centers) + 1), lambda j: {{'a': means[j], 'b': centers[j]}}) AS list_zip_pairs FROM (
  SELECT part, {keep}, centers, wss, pick,
    list_transform(range(1, len(centers) + 1), lambda j: coalesce(list_filter(found, lambda f: f.cluster = j)[1].mean, centers[j])) AS means FROM (
   SELECT part, {keep}, centers, sum(wss) AS wss, list({{'cluster': cluster, 'mean': mean}}) AS found,
     arg_max(pick, (wss, -cluster)) FILTER (pick IS NOT NULL) AS pick FROM (
    SELECT part, {keep}, centers, cluster, [{mean}] AS mean, sum(n * d) AS wss, arg_max(x, (d, -i)) FILTER (d > 0 AND i <= {START_ROWS}) AS pick FROM (
     SELECT *, list_min(ds) AS d, list_position(ds, list_min(ds)) AS cluster FROM (
      SELECT s.part, {', '.join('s.' + k.strip() for k in keep.split(','))}, s.centers, r.u, r.x, r.n, r.i,
        list_transform(s.centers, lambda c: {_distance('c', 'r.x', width)}) AS ds
      FROM {state} s JOIN km_rows r ON r.part = s.part WHERE {going}))
    GROUP BY part, {keep}, centers, cluster)
   GROUP BY part, {keep}, centers)))"""


def fixed(points: str, columns: Sequence[str], ks: Sequence[int]) -> Steps:
    """``km_fit`` (part, k, centers, wss): one fit per k, from rows that lie far apart."""
    width = len(columns)
    starts = f"""
SELECT part, 1 AS k, [x] AS centers FROM km_rows WHERE i = 1 UNION ALL
SELECT part, k + 1, list_append(centers, arg_max(x, (d, -i))) FROM (
  SELECT s.part, s.k, s.centers, r.x, r.i, list_min(list_transform(s.centers, lambda c: {_distance('c', 'r.x', width)})) AS d
  FROM km_starts s JOIN km_rows r ON r.part = s.part WHERE r.i <= {START_ROWS} AND s.k < {max(ks)})
GROUP BY part, k, centers HAVING max(d) > 0"""
    # fewer rows than centres: as many centres as there are rows
    first = f"""SELECT part, w.k, arg_max(centers, s.k) AS centers, true AS moved, CAST(NULL AS DOUBLE) AS wss
FROM km_starts s, (SELECT unnest({list(ks)}) AS k) w WHERE s.k <= w.k GROUP BY part, w.k"""
    step = _round("km_rounds", "s.moved", width, "k")
    return [
        *_rows(points, columns),
        ("km_starts", starts),
        ("km_rounds", f"{first} UNION ALL SELECT part, k, CASE WHEN far THEN means ELSE centers END, far, wss FROM ({step})"),
        ("km_fit", "SELECT part, k, list_sort(centers) AS centers, wss FROM km_rounds WHERE NOT moved"),
    ]


def estimated(points: str, columns: Sequence[str], k_max: int) -> Steps:
    """``km_fit`` (part, k, centers, wss): clusters are added while each lowers the sum of squares enough."""
    width = len(columns)
    first = """SELECT part, 1 AS k, [x] AS centers, CAST(NULL AS DOUBLE[][]) AS best, CAST(NULL AS DOUBLE) AS best_wss, false AS done
FROM km_rows WHERE i = 1"""
    step = _round("km_rounds", "NOT s.done", width, "k, best, best_wss")
    worse = "best_wss IS NOT NULL AND 1 - wss / best_wss <= cutoff"
    ends = f"(k >= {k_max} OR wss <= 0 OR pick IS NULL)"
    moves = f"""
SELECT part, CASE WHEN far OR {worse} OR {ends} THEN k ELSE k + 1 END,
  CASE WHEN far THEN means WHEN {worse} OR {ends} THEN centers ELSE list_append(centers, pick) END,
  CASE WHEN far OR {worse} THEN best ELSE centers END, CASE WHEN far OR {worse} THEN best_wss ELSE wss END, NOT far AND ({worse} OR {ends})
FROM (SELECT * FROM ({step}) JOIN km_cutoff USING (part))"""
    return [
        *_rows(points, columns),
        ("km_cutoff", f"SELECT part, least(0.02::DOUBLE + 10.0::DOUBLE / count(*) + 2.5::DOUBLE / {width * width}, 0.8) AS cutoff FROM km_points GROUP BY part"),
        ("km_rounds", f"{first} UNION ALL {moves}"),
        ("km_fit", "SELECT part, len(best) AS k, list_sort(best) AS centers, best_wss AS wss FROM km_rounds WHERE done"),
    ]


def numbered(columns: Sequence[str], k: str = "true") -> str:
    """The number of a row's nearest centre in the fit of ``k``, as a scalar subquery."""
    x = "[" + ", ".join(f"round({c} * {UNIT}.0) / {UNIT}.0" for c in columns) + "]"
    ds = f"list_transform(centers, lambda c: {_distance('c', x, len(columns))})"
    return f"(SELECT CAST(list_position({ds}, list_min({ds})) AS INT) FROM km_fit WHERE {k})"


def centre_rows(columns: Sequence[str], names: Sequence[str], k: str = "true", part: str = "") -> str:
    """Centres as rows, numbered in their order."""
    values = ", ".join(f"round(centers[j][{i}], 6) AS {name}" for i, name in enumerate(names, start=1))
    return f"SELECT {part}CAST(j AS INT) AS centroid, {values} FROM (SELECT *, unnest(range(1, len(centers) + 1)) AS j FROM km_fit WHERE {k})"
