"""The graph queries and their SQL: query text on the trade graph, and algorithms on bipartite or derived edges."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import Graph, from_star_schema
from .operators import algorithms, analysis, structure, traversal
from .plans import run_query, run_update
from .streaming import changes, windowed_counts

#: name: (query text, SQL)
TEXTS: dict[str, tuple[str, str]] = {
    "scan_label_count": ("MATCH (c:Customer)-[:IN_NATION]->(n:Nation) RETURN n.name AS nation, count(*) AS customers",
        "SELECT n_name AS nation, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1"),
    "scan_all": ("MATCH (n) RETURN n.labels[0] AS label, count(*) AS n",
        "SELECT 'Region' AS label, count(*) AS n FROM region UNION ALL SELECT 'Nation', count(*) FROM nation UNION ALL SELECT 'Customer', count(*) FROM customer UNION ALL SELECT 'Supplier', count(*) FROM supplier UNION ALL SELECT 'Part', count(*) FROM part UNION ALL SELECT 'Order', count(*) FROM orders"),
    "scan_label_property": ("MATCH (p:Part {size: 10}) WHERE p.retailprice > 100.0 RETURN p.partkey AS k, p.name AS name",
        "SELECT p_partkey AS k, p_name AS name FROM part WHERE p_size = 10 AND p_retailprice > 100"),
    "scan_by_id": ("MATCH (n:Nation) WHERE id(n) = 1000000000007 RETURN n.name AS name", "SELECT n_name AS name FROM nation WHERE n_nationkey = 7"),
    "scan_label_or": ("MATCH (n:Customer|Supplier) RETURN labels(n)[0] AS label, sum(n.acctbal) > 0.0 AS rich, count(n.id) AS n",
        "SELECT 'Customer' AS label, sum(c_acctbal) > 0 AS rich, count(*) AS n FROM customer UNION ALL SELECT 'Supplier', sum(s_acctbal) > 0, count(*) FROM supplier"),
    "edge_type_count": ("MATCH ()-[e:PLACED]->() RETURN count(*) AS n", "SELECT count(*) AS n FROM orders"),
    "edge_property_value": ("MATCH (o:Order)-[e:CONTAINS]->(p:Part) WHERE e.quantity = 30.0 RETURN p.brand AS brand, count(*) AS n",
        "SELECT p_brand AS brand, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON o_orderkey = l_orderkey WHERE l_quantity = 30 GROUP BY 1"),
    "edge_property_range": ("MATCH (:Order)-[e:CONTAINS]->(:Part) WHERE 10.0 <= e.quantity < 12.0 AND e.discount IS NOT NULL RETURN count(*) AS n, max(e.quantity) AS top",
        "SELECT count(*) AS n, max(l_quantity) AS top FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey WHERE l_quantity >= 10 AND l_quantity < 12 AND l_discount IS NOT NULL"),
    "expand_two_hops": ("MATCH (c:Customer)-[:IN_NATION]->(n:Nation)-[:IN_REGION]->(r:Region) RETURN r.name AS region, count(*) AS n, avg(c.acctbal) > 4000.0 AS high",
        "SELECT r_name AS region, count(*) AS n, avg(c_acctbal) > 4000 AS high FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1"),
    "expand_three_hops": ("MATCH (c:Customer)-[:PLACED]->(o:Order)-[:CONTAINS]->(p:Part) WHERE p.size < 5 RETURN c.mktsegment AS segment, count(DISTINCT p.partkey) AS parts, count(*) AS n",
        "SELECT c_mktsegment AS segment, count(DISTINCT p_partkey) AS parts, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE p_size < 5 GROUP BY 1"),
    "expand_in": ("MATCH (n:Nation)<-[:IN_NATION]-(s:Supplier) RETURN n.name AS nation, min(s.acctbal) AS least", "SELECT n_name AS nation, min(s_acctbal) AS least FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1"),
    "expand_both_unique": ("MATCH (a:Nation)-[x:IN_REGION]-(r:Region)-[y:IN_REGION]-(b:Nation) WHERE a.name < b.name RETURN r.name AS region, count(*) AS n",
        "SELECT r_name AS region, count(*) AS n FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_name < b.n_name JOIN region ON r_regionkey = a.n_regionkey GROUP BY 1"),
    "expand_existing": ("MATCH (c:Customer)-[:IN_NATION]->(n:Nation), (s:Supplier)-[:IN_NATION]->(n) RETURN n.name AS nation, count(*) AS pairs",
        "SELECT n_name AS nation, count(*) AS pairs FROM customer JOIN supplier ON c_nationkey = s_nationkey JOIN nation ON n_nationkey = c_nationkey GROUP BY 1"),
    "optional_match": ("MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o:Order) WHERE o.totalprice > 200000.0 RETURN c.mktsegment AS segment, count(o.id) AS large, count(*) AS n",
        "SELECT c_mktsegment AS segment, count(o_orderkey) AS large, count(*) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 200000 GROUP BY 1"),
    "exists_subquery": ("MATCH (c:Customer) WHERE EXISTS { MATCH (c)-[:PLACED]->(o:Order) WHERE o.orderstatus = 'F' } RETURN c.mktsegment AS segment, count(*) AS n",
        "SELECT c_mktsegment AS segment, count(*) AS n FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') GROUP BY 1"),
    "not_exists_subquery": ("MATCH (c:Customer) WHERE NOT EXISTS { (c)-[:PLACED]->(:Order) } RETURN count(*) AS n",
        "SELECT count(*) AS n FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)"),
    "var_length": ("MATCH (c:Customer)-[e*1..2]->(x:Region) RETURN x.name AS region, count(*) AS n",
        "SELECT r_name AS region, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1"),
    "var_length_open": ("MATCH (c:Customer)-[e:PLACED|CONTAINS*]->(p:Part) RETURN p.partkey AS k, count(*) AS n",
        "SELECT p_partkey AS k, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey GROUP BY 1"),
    "bfs_depth": ("MATCH (s:Supplier)-[d:IN_NATION|IN_REGION *BFS ..2]->(x) RETURN size(d) AS depth, count(*) AS n",
        "SELECT 1 AS depth, count(*) AS n FROM supplier UNION ALL SELECT 2, count(*) FROM supplier"),
    "order_skip_limit": ("MATCH (p:Part) RETURN p.partkey AS k, p.retailprice AS price ORDER BY p.retailprice DESC, p.partkey SKIP 5 LIMIT 10",
        "SELECT p_partkey AS k, p_retailprice AS price FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 10 OFFSET 5"),
    "distinct": ("MATCH (p:Part) RETURN DISTINCT p.brand AS brand, p.size AS size", "SELECT DISTINCT p_brand AS brand, p_size AS size FROM part"),
    "with_having": ("MATCH (c:Customer)-[:PLACED]->(o:Order) WITH c, count(*) AS n WHERE n > 15 RETURN c.custkey AS k, n",
        "SELECT c_custkey AS k, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1 HAVING count(*) > 15"),
    "unwind_literal": ("UNWIND [3, 1, 2, 2] AS x RETURN x, x * 2 AS y, 7 / 2 AS whole, 2 ^ 3 AS power", "SELECT x::BIGINT AS x, (x * 2)::BIGINT AS y, 3::BIGINT AS whole, 8.0::DOUBLE AS power FROM (VALUES (3), (1), (2), (2)) t(x)"),
    "union_distinct": ("MATCH (n:Nation) RETURN n.regionkey AS k UNION MATCH (r:Region) RETURN r.regionkey AS k", "SELECT n_regionkey AS k FROM nation UNION SELECT r_regionkey FROM region"),
    "union_all": ("MATCH (n:Nation) RETURN n.regionkey AS k UNION ALL MATCH (r:Region) RETURN r.regionkey AS k", "SELECT n_regionkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region"),
    "cartesian": ("MATCH (a:Region), (b:Nation) WHERE a.name < b.name RETURN count(*) AS n", "SELECT count(*) AS n FROM region, nation WHERE r_name < n_name"),
    "hash_join": ("MATCH (c:Customer), (s:Supplier) WHERE c.nationkey = s.nationkey AND c.acctbal < s.acctbal RETURN count(*) AS n", "SELECT count(*) AS n FROM customer JOIN supplier ON c_nationkey = s_nationkey AND c_acctbal < s_acctbal"),
    "sum_of_nothing": ("MATCH (p:Part) WHERE p.size < 0 RETURN sum(p.size) AS s, count(*) AS n, avg(p.size) AS a, min(p.size) AS m", "SELECT 0::BIGINT AS s, 0::BIGINT AS n, NULL::DOUBLE AS a, NULL::INT AS m"),
    "string_predicates": ("MATCH (p:Part) WHERE p.name STARTS WITH 'P' OR p.name CONTAINS 'a' OR p.type ENDS WITH 'L' RETURN count(*) AS n", "SELECT count(*) AS n FROM part WHERE starts_with(p_name, 'P') OR contains(p_name, 'a') OR ends_with(p_type, 'L')"),
    "regex_full_match": ("MATCH (n:Nation) WHERE n.name =~ '.*[AI].*' RETURN n.name AS name", "SELECT n_name AS name FROM nation WHERE regexp_full_match(n_name, '.*[AI].*')"),
    "case_in_null": ("MATCH (p:Part) RETURN CASE WHEN p.size IN [1, 2, 3] THEN 'low' WHEN p.size > 40 THEN 'high' END AS band, count(*) AS n",
        "SELECT CASE WHEN p_size IN (1, 2, 3) THEN 'low' WHEN p_size > 40 THEN 'high' END AS band, count(*) AS n FROM part GROUP BY 1"),
    "list_expressions": ("UNWIND range(1, 5) AS x WITH x, [y IN range(1, x) WHERE y % 2 = 1 | y * y] AS odd RETURN x, size(odd) AS n, head(odd) AS first, last(odd) AS final, reduce(s = 0, y IN odd | s + y) AS total, all(y IN odd WHERE y > 0) AS positive, [1, 2, 3, 4][1..3] = [2, 3] AS sliced, [1, 2][-1] AS back",
        "SELECT x, len(odd) AS n, odd[1] AS first, odd[-1] AS final, list_sum(odd)::BIGINT AS total, TRUE AS positive, TRUE AS sliced, 2::BIGINT AS back FROM (SELECT x, list_transform(list_filter(range(1, x + 1), lambda y: y % 2 = 1), lambda y: y * y) AS odd FROM range(1, 6) t(x))"),
    "scalar_functions": ("UNWIND [-1.5, 2.0] AS x RETURN x, abs(x) AS a, ceil(x) AS c, floor(x) AS f, round(x) AS r, sign(x) AS s, toInteger('12.7') AS i, toBoolean('TRUE') AS b, toLower('AbC') AS l, substring('hello', 1, 3) AS sub, split('a.b.c', '.')[1] AS part, coalesce(null, 4) AS k",
        "SELECT x::DOUBLE AS x, abs(x)::DOUBLE AS a, ceil(x)::DOUBLE AS c, floor(x)::DOUBLE AS f, round(x)::DOUBLE AS r, sign(x)::INT AS s, 12::BIGINT AS i, TRUE AS b, 'abc' AS l, 'ell' AS sub, 'b' AS part, 4::BIGINT AS k FROM (VALUES (-1.5), (2.0)) t(x)"),
    "collection_library": ("UNWIND range(1, 4) AS x WITH x, [y IN range(0, x) | y % 3] AS l RETURN x, collections.sum(l) AS s, collections.max(l) AS top, size(collections.to_set(l)) AS kinds, collections.contains(l, 2) AS two, size(collections.partition(l, 2)) AS parts, size(collections.duplicates(l)) AS again",
        "SELECT x, list_sum(l)::DOUBLE AS s, list_max(l) AS top, len(list_distinct(l)) AS kinds, list_contains(l, 2) AS two, ((len(l) + 1) // 2) AS parts, len(list_filter(list_distinct(l), lambda v: len(list_filter(l, lambda w: w = v)) > 1)) AS again FROM (SELECT x, list_transform(range(0, x + 1), lambda y: y % 3) AS l FROM range(1, 5) t(x))"),
    "text_library": ("MATCH (p:Part) RETURN p.partkey AS k, text.distance(p.brand, p.name) AS d, text.regreplace(p.brand, '[0-9]', '#') AS masked, text.indexOf(p.name, 'a') AS first, util.md5([p.brand, p.name]) AS h",
        "SELECT p_partkey AS k, levenshtein(p_brand, p_name) AS d, regexp_replace(p_brand, '[0-9]', '#', 'g') AS masked, (instr(p_name, 'a') - 1)::BIGINT AS first, md5(p_brand || p_name) AS h FROM part"),
    "where_and_or": ("MATCH (p:Part) WHERE p.size = 1 AND p.size = 2 OR p.size = 3 AND NOT p.brand = 'Brand#11' RETURN p.partkey AS k", "SELECT p_partkey AS k FROM part WHERE p_size = 3 AND p_brand != 'Brand#11'"),
    "unbounded_trails": ("MATCH (c:Customer)-[e:IN_NATION|IN_REGION|PLACED*]->(x) RETURN size(e) AS hops, labels(x)[0] AS label, count(*) AS n",
        "SELECT 1 AS hops, 'Nation' AS label, count(*) AS n FROM customer UNION ALL SELECT 2, 'Region', count(*) FROM customer UNION ALL SELECT 1, 'Order', count(*) FROM orders"),
    "unique_across_patterns": ("MATCH (a:Nation)-[:IN_REGION]->(r:Region), (b:Nation)-[:IN_REGION]->(r) RETURN r.name AS region, count(*) AS n",
        "SELECT r_name AS region, count(*) AS n FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey != b.n_nationkey JOIN region ON r_regionkey = a.n_regionkey GROUP BY 1"),
    "label_and": ("MATCH (a:Nation:Region) RETURN count(*) AS n", "SELECT 0::BIGINT AS n"),
    "integer_division": ("MATCH (p:Part) RETURN p.partkey AS k, p.size / 7 AS whole, p.size % 7 AS rest, p.size / 8.0 AS part", "SELECT p_partkey AS k, (p_size // 7)::BIGINT AS whole, (p_size % 7)::BIGINT AS rest, p_size / 8.0::DOUBLE AS part FROM part"),
    "string_concat": ("MATCH (p:Part) RETURN p.partkey AS k, p.brand + '/' + p.name + p.size AS t, size(p.name) AS n", "SELECT p_partkey AS k, p_brand || '/' || p_name || p_size AS t, length(p_name) AS n FROM part"),
    "named_path": ("MATCH p = (c:Customer)-[:IN_NATION]->(n:Nation)-[:IN_REGION]->(r) WHERE c.acctbal > 9000 RETURN [x IN nodes(p) | x.name] AS names, length(p) AS hops, [r IN relationships(p) | type(r)] AS types",
        "SELECT [c_name, n_name, r_name] AS names, 2::BIGINT AS hops, ['IN_NATION', 'IN_REGION'] AS types FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_acctbal > 9000"),
    "pattern_comprehension": ("MATCH (n:Nation) RETURN n.name AS nation, size([(n)<-[:IN_NATION]-(s:Supplier) WHERE s.acctbal > 0 | s.name]) AS n",
        "SELECT n_name AS nation, count(s_suppkey)::INT AS n FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 0 GROUP BY 1"),
    "count_subquery": ("MATCH (c:Customer) WHERE COUNT { (c)-[:PLACED]->(o:Order) WHERE o.orderstatus = 'O' } > 5 RETURN c.custkey AS k, COUNT { (c)-[:PLACED]->() } AS n",
        "SELECT c_custkey AS k, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1 HAVING count(*) FILTER (WHERE o_orderstatus = 'O') > 5"),
    "exists_or": ("MATCH (c:Customer) WHERE c.acctbal > 9000 OR EXISTS { (c)-[:PLACED]->(o:Order) WHERE o.totalprice > 400000 } RETURN c.custkey AS k, NOT (c)-[:PLACED]->() AS idle",
        "SELECT c_custkey AS k, NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS idle FROM customer WHERE c_acctbal > 9000 OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)"),
    "call_correlated": ("MATCH (n:Nation) CALL { WITH n MATCH (n)<-[:IN_NATION]-(c:Customer) RETURN count(c) AS customers, max(c.acctbal) AS top } RETURN n.name AS nation, customers, top",
        "SELECT n_name AS nation, count(c_custkey) AS customers, max(c_acctbal) AS top FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1"),
    "call_correlated_top": ("MATCH (n:Nation) CALL { WITH n MATCH (n)<-[:IN_NATION]-(s:Supplier) RETURN s.suppkey AS best ORDER BY s.acctbal DESC, s.suppkey LIMIT 2 } RETURN n.name AS nation, best",
        "SELECT n_name AS nation, s_suppkey AS best FROM nation JOIN supplier ON s_nationkey = n_nationkey QUALIFY row_number() OVER (PARTITION BY n_nationkey ORDER BY s_acctbal DESC, s_suppkey) <= 2"),
    "map_projection": ("MATCH (r:Region) RETURN r {.name, key: r.regionkey}.name AS name, keys(r {.name, twice: r.regionkey * 2}) AS keys", "SELECT r_name AS name, ['name', 'twice'] AS keys FROM region"),
    "degree_functions": ("MATCH (n:Nation) RETURN n.name AS nation, degree(n) AS d, inDegree(n) AS i, outDegree(n) AS o",
        "SELECT n_name AS nation, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) + (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) + 1 AS d, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) + (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS i, 1::BIGINT AS o FROM nation"),
    "ends_of_relationships": ("MATCH (:Nation)-[e:IN_REGION]->(:Region) RETURN startNode(e).name AS nation, endNode(e).name AS region, type(e) AS t", "SELECT n_name AS nation, r_name AS region, 'IN_REGION' AS t FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "bfs_path": ("MATCH p = (s:Supplier)-[:IN_NATION|IN_REGION *BFS]->(r:Region) RETURN s.suppkey AS k, [n IN nodes(p) | n.name] AS names", "SELECT s_suppkey AS k, [s_name, n_name, r_name] AS names FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"),
    "all_shortest": ("MATCH (n:Nation {nationkey: 3})<-[e:IN_NATION|PLACED *ALLSHORTEST (r, x | 1.5) total]-(o:Customer) RETURN o.custkey AS k, total, size(e) AS hops", "SELECT c_custkey AS k, 1.5::DOUBLE AS total, 1 AS hops FROM customer WHERE c_nationkey = 3"),
    "k_shortest": ("MATCH (a:Nation {nationkey: 3}), (b:Region) WHERE b.regionkey < 3 MATCH (a)-[e:IN_REGION *KSHORTEST ..3|2]->(b) RETURN b.regionkey AS region, size(e) AS hops", "SELECT n_regionkey AS region, 1 AS hops FROM nation WHERE n_nationkey = 3 AND n_regionkey < 3"),
    "filter_lambda": ("MATCH (c:Customer)-[e:PLACED|CONTAINS *1..2 (r, n | n.totalprice > 300000 OR r.quantity >= 45)]->(x) RETURN labels(x)[0] AS label, count(*) AS n",
        "SELECT 'Order' AS label, count(*) AS n FROM orders WHERE o_totalprice > 300000 UNION ALL SELECT 'Part', count(*) FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE o_totalprice > 300000 AND l_quantity >= 45"),
    "hops_limit": ("USING HOPS LIMIT 7 MATCH (n:Nation)-[:IN_REGION]->(r) RETURN count(*) AS n", "SELECT 7::BIGINT AS n"),
    "collect_map": ("MATCH (r:Region) RETURN collect(r.name, r.regionkey)['ASIA'] AS asia, size(collect(r.name)) AS n", "SELECT max(CASE WHEN r_name = 'ASIA' THEN r_regionkey END) AS asia, count(*)::INT AS n FROM region"),
    "project_graph": ("MATCH p = (:Nation)-[:IN_REGION]->(r:Region) RETURN r.name AS region, size(project(p).nodes) AS nodes, size(project(p).edges) AS edges", "SELECT r_name AS region, (count(*) + 1)::INT AS nodes, count(*)::INT AS edges FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1"),
    "temporal_arithmetic": ("MATCH (o:Order) WITH date(o.orderdate) AS d WITH d, d + duration('P30D') AS due RETURN d.year AS y, due.month AS m, count(*) AS n, max((due - d).day) AS days", "SELECT year(o_orderdate) AS y, month(o_orderdate::DATE + 30) AS m, count(*) AS n, 30::BIGINT AS days FROM orders GROUP BY 1, 2"),
    "point_distance": ("MATCH (p:Part) WITH p, point({x: toFloat(p.size), y: 1.0}) AS at WHERE point.distance(at, point({x: 10, y: 1})) < 3 AND point.withinbbox(at, point({x: 8, y: 0}), point({x: 11, y: 2})) RETURN p.partkey AS k, at.x AS x", "SELECT p_partkey AS k, p_size::DOUBLE AS x FROM part WHERE p_size BETWEEN 8 AND 11"),
    "order_by_aggregate": ("MATCH (c:Customer) RETURN c.mktsegment AS s, count(*) AS n ORDER BY avg(c.acctbal) DESC, s LIMIT 3", "SELECT c_mktsegment AS s, count(*) AS n FROM customer GROUP BY 1 ORDER BY avg(c_acctbal) DESC, s LIMIT 3"),
    "call_subquery": ("CALL { MATCH (p:Part) RETURN max(p.size) AS top } MATCH (q:Part) WHERE q.size = top RETURN q.partkey AS k, top", "SELECT p_partkey AS k, p_size AS top FROM part WHERE p_size = (SELECT max(p_size) FROM part)"),
    "scan_edges": ("MATCH ()-[e]->() RETURN type(e) AS t, count(*) AS n", "SELECT 'IN_REGION' AS t, count(*) AS n FROM nation UNION ALL SELECT 'IN_NATION', (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) UNION ALL SELECT 'PLACED', count(*) FROM orders UNION ALL SELECT 'CONTAINS', count(*) FROM lineitem UNION ALL SELECT 'SUPPLIED_BY', count(*) FROM lineitem"),
    "scan_edge_property": ("MATCH ()-[e]->() WHERE e.quantity >= 49 RETURN type(e) AS t, count(*) AS n", "SELECT 'CONTAINS' AS t, count(*) AS n FROM lineitem WHERE l_quantity >= 49 UNION ALL SELECT 'SUPPLIED_BY', count(*) FROM lineitem WHERE l_quantity >= 49"),
    "scan_edge_property_value": ("MATCH ()-[e {returnflag: 'R'}]->() RETURN type(e) AS t, max(e.quantity) AS top", "SELECT 'CONTAINS' AS t, max(l_quantity) AS top FROM lineitem WHERE l_returnflag = 'R' UNION ALL SELECT 'SUPPLIED_BY', max(l_quantity) FROM lineitem WHERE l_returnflag = 'R'"),
    "scan_edge_property_exists": ("MATCH ()-[e]->() WHERE e.returnflag IS NOT NULL AND 10 < e.quantity <= 11 RETURN count(*) AS n", "SELECT 2 * count(*) AS n FROM lineitem WHERE l_returnflag IS NOT NULL AND l_quantity > 10 AND l_quantity <= 11"),
    "scan_edge_by_id": ("MATCH (a)-[e]->(b) WHERE id(e) = 1000000000007 RETURN labels(a)[0] AS a, type(e) AS t, labels(b)[0] AS b", "SELECT 'Customer' AS a, 'IN_NATION' AS t, 'Nation' AS b FROM customer WHERE c_custkey = 7"),
    "scan_vertex_property": ("MATCH (n) WHERE n.acctbal > 9000 RETURN labels(n)[0] AS label, count(*) AS n", "SELECT 'Customer' AS label, count(*) AS n FROM customer WHERE c_acctbal > 9000 HAVING count(*) > 0 UNION ALL SELECT 'Supplier', count(*) FROM supplier WHERE s_acctbal > 9000 HAVING count(*) > 0"),
    "math_functions": ("UNWIND [0.25, 0.5, 1.0] AS x RETURN x, round(acos(x) * 1000000) AS a, round(asin(x) * 1000000) AS b, round(atan(x) * 1000000) AS c, round(atan2(x, 2.0) * 1000000) AS d, round(cos(x) * 1000000) AS e, round(sin(x) * 1000000) AS f, round(tan(x) * 1000000) AS g, round(exp(x) * 1000000) AS h, round(log(x) * 1000000) AS i, round(log10(x) * 1000000) AS j, round(sqrt(x) * 1000000) AS k, round(pi() * 1000) AS p, round(e() * 1000) AS q, rand() < 1 AS r",
        "SELECT x::DOUBLE AS x, round(acos(x) * 1000000)::DOUBLE AS a, round(asin(x) * 1000000)::DOUBLE AS b, round(atan(x) * 1000000)::DOUBLE AS c, round(atan2(x, 2.0) * 1000000)::DOUBLE AS d, round(cos(x) * 1000000)::DOUBLE AS e, round(sin(x) * 1000000)::DOUBLE AS f, round(tan(x) * 1000000)::DOUBLE AS g, round(exp(x) * 1000000)::DOUBLE AS h, round(ln(x) * 1000000)::DOUBLE AS i, round(log10(x) * 1000000)::DOUBLE AS j, round(sqrt(x) * 1000000)::DOUBLE AS k, 3142.0::DOUBLE AS p, 2718.0::DOUBLE AS q, TRUE AS r FROM (VALUES (0.25::DOUBLE), (0.5), (1.0)) t(x)"),
    "conversion_functions": ("MATCH (p:Part) RETURN p.partkey AS k, toFloat(p.size) AS f, toString(p.size) AS s, toInteger(p.retailprice) AS i, toInteger('x' + p.name) IS NULL AS bad, valueType(p.name) AS t, toBoolean('false') AS b",
        "SELECT p_partkey AS k, p_size::DOUBLE AS f, p_size::VARCHAR AS s, trunc(p_retailprice)::BIGINT AS i, TRUE AS bad, 'STRING' AS t, FALSE AS b FROM part"),
    "list_functions": ("UNWIND range(1, 6) AS x WITH x, range(x, 1, -1) AS l RETURN x, tail(l) AS t, reverse(l) AS r, toSet(l + l) AS s, extract(y IN l | y * 2) AS e, filter(y IN l WHERE y > 2) AS f, single(y IN l WHERE y = 1) AS one, none(y IN l WHERE y > 9) AS no, any(y IN l WHERE y = 5) AS five, isEmpty(l) AS empty",
        "SELECT x, l[2:] AS t, list_reverse(l) AS r, l AS s, list_transform(l, lambda y: y * 2) AS e, list_filter(l, lambda y: y > 2) AS f, TRUE AS one, TRUE AS no, x >= 5 AS five, FALSE AS empty FROM (SELECT x, range(x, 0, -1) AS l FROM range(1, 7) t(x))"),
    "string_functions": ("MATCH (n:Nation) RETURN n.name AS name, right(n.name, 2) AS r, left(n.name, 2) AS l, trim('  ' + n.name + ' ') AS t, reverse(n.name) AS b, replace(n.name, 'A', '*') AS x, toUpper(toLower(n.name)) AS u, size(split(n.name, 'A')) AS parts",
        "SELECT n_name AS name, right(n_name, 2) AS r, left(n_name, 2) AS l, n_name AS t, reverse(n_name) AS b, replace(n_name, 'A', '*') AS x, upper(n_name) AS u, len(string_split(n_name, 'A'))::INT AS parts FROM nation"),
    "entity_functions": ("MATCH (r:Region) RETURN r.name AS name, keys(r) AS k, properties(r).name AS p, size(keys(properties(r))) AS n, elementId(r) AS e", "SELECT r_name AS name, ['regionkey', 'name'] AS k, r_name AS p, 2 AS n, r_regionkey::VARCHAR AS e FROM region"),
    "collect_list": ("MATCH (n:Nation)-[:IN_REGION]->(r) WITH r, n ORDER BY n.name RETURN r.name AS region, size(collect(n.name)) AS n, collections.sort(collect(n.nationkey)) AS keys", "SELECT r_name AS region, count(*)::INT AS n, list_sort(list(n_nationkey)) AS keys FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1"),
    "map_library": ("MATCH (r:Region) WITH r, map.from_pairs([['a', r.name], ['b', 'x']]) AS m RETURN m.a AS a, map.get(m, 'z', 'none') AS z, size(keys(map.merge(m, map.from_lists(['c'], ['y'])))) AS n, keys(map.remove_key(m, 'a')) AS k, map.set_key(m, 'b', 'q')['b'] AS q", "SELECT r_name AS a, 'none' AS z, 3 AS n, ['b'] AS k, 'q' AS q FROM region"),
    "collection_library_more": ("UNWIND range(2, 5) AS x WITH x, range(1, x) AS l RETURN x, collections.avg(l) AS a, collections.min(l) AS m, collections.sum_longs(l) AS s, collections.contains_all(l, [1, 2]) AS c, collections.intersection(l, [2, 9]) AS i, collections.subtract(l, [1]) AS t, collections.union_all(l, [7]) AS u, size(collections.union(l, [1, 7])) AS n, collections.contains_sorted(l, 3) AS z, collections.flatten([l, [0]]) AS f, collections.disjunction([1, 2], [2, 3]) AS d, size(collections.pairs(l)) AS p",
        "SELECT x, list_avg(l) AS a, 1::BIGINT AS m, list_sum(l)::BIGINT AS s, TRUE AS c, [2::BIGINT] AS i, l[2:] AS t, l || [7::BIGINT] AS u, (x + 1)::INT AS n, x >= 3 AS z, l || [0::BIGINT] AS f, [1::BIGINT, 3] AS d, x::INT AS p FROM (SELECT x, range(1, x + 1) AS l FROM range(2, 6) t(x))"),
    "text_library_more": ("MATCH (n:Nation) RETURN n.name AS name, text.join([n.name, 'x'], '-') AS j, text.replace(n.name, 'A', 'a') AS r, text.format('{}:{}', n.name, n.nationkey) AS f, text.compare_cleaned(n.name + '!', toLower(n.name)) AS c, size(uuid.get()) AS u, math.round(n.nationkey / 3.0, 1) AS m",
        "SELECT n_name AS name, n_name || '-x' AS j, replace(n_name, 'A', 'a') AS r, n_name || ':' || n_nationkey AS f, TRUE AS c, 36::BIGINT AS u, round(n_nationkey / 3.0::DOUBLE, 1)::DOUBLE AS m FROM nation"),
    "date_library": ("MATCH (o:Order) WITH toString(date(o.orderdate)) AS d RETURN d, count(*) AS n, date.parse(d, 'yyyy-MM-dd') AS ms, date.format(date.parse(d, 'yyyy-MM-dd'), 'yyyy/MM') AS f, date.convert_format(d, 'yyyy-MM-dd', 'dd.MM.yyyy') AS c, date.add(0, 2, 'd') AS a",
        "SELECT strftime(o_orderdate, '%Y-%m-%d') AS d, count(*) AS n, epoch_ms(o_orderdate::DATE::TIMESTAMP) AS ms, strftime(o_orderdate::DATE, '%Y/%m') AS f, strftime(o_orderdate::DATE, '%d.%m.%Y') AS c, 172800000::BIGINT AS a FROM orders GROUP BY 1, 3, 4, 5"),
    "temporal_functions": ("MATCH (o:Order) WITH localDateTime(o.orderdate) AS t RETURN t.year AS y, t.month AS m, count(*) AS n, min(timestamp(t)) AS first, max(date(t)) AS last, duration({day: 1, hour: 12}).hour AS h, localTime('10:20:30').minute AS mi, datetime('2024-01-22T09:12:31+01:00').hour AS z",
        "SELECT year(o_orderdate) AS y, month(o_orderdate) AS m, count(*) AS n, min(epoch_us(o_orderdate)) AS first, max(o_orderdate::DATE) AS last, 12::BIGINT AS h, 20::BIGINT AS mi, 9::BIGINT AS z FROM orders GROUP BY 1, 2"),
    "earth_points": ("MATCH (n:Nation) WITH n, point({longitude: n.nationkey * 1.0, latitude: 0.0}) AS p RETURN n.nationkey AS k, round(point.distance(p, point({longitude: 0.0, latitude: 0.0})) / 1000) AS km, p.longitude AS l, p.srid AS s", "SELECT n_nationkey AS k, round(2 * 6371 * asin(sin(radians(n_nationkey) / 2)))::DOUBLE AS km, n_nationkey::DOUBLE AS l, 4326::BIGINT AS s FROM nation"),
    "call_degree_rows": ("MATCH (n:Nation) CALL node.degree_in(n, 'IN_NATION') YIELD value RETURN n.name AS nation, value AS n", "SELECT n_name AS nation, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) + (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS n FROM nation"),
    "call_degree_out": ("MATCH (n:Region) CALL node.degree_out(n) YIELD value RETURN n.name AS region, value AS n", "SELECT r_name AS region, 0::BIGINT AS n FROM region"),
    "call_by_hop": ("MATCH (r:Region) CALL neighbors.by_hop(r, ['IN_REGION', 'IN_NATION'], 2) YIELD node, depth RETURN r.name AS region, depth, count(*) AS n", "SELECT r_name AS region, 1 AS depth, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1 UNION ALL SELECT r_name, 2, count(*) FROM (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier) JOIN nation ON k = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1"),
    "call_simple_paths": ("MATCH (s:Supplier), (r:Region) WHERE s.suppkey < 9 CALL algo.all_simple_paths(s, r, ['IN_NATION', 'IN_REGION'], 3) YIELD path RETURN s.suppkey AS k, r.name AS region, size(path) AS n", "SELECT s_suppkey AS k, r_name AS region, 3 AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE s_suppkey < 9"),
    "call_has_path": ("MATCH (n:Nation), (r:Region) CALL nxalg.has_path(n, r) YIELD has_path WITH n, has_path WHERE has_path RETURN count(*) AS n", "SELECT count(*) AS n FROM nation"),
    "call_path_length": ("MATCH (n:Nation), (r:Region) CALL nxalg.shortest_path_length(n, r) YIELD length RETURN n.name AS nation, r.name AS region, length", "SELECT n_name AS nation, r_name AS region, 1.0::DOUBLE AS length FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "call_descendants": ("MATCH (n:Nation) CALL graph_util.descendants(n) YIELD node RETURN n.name AS nation, node.name AS region", "SELECT n_name AS nation, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "call_ancestors": ("MATCH (r:Region) CALL graph_util.ancestors(r) YIELD node, depth WITH r, node, depth WHERE depth = 1 RETURN r.name AS region, node.name AS nation", "SELECT r_name AS region, n_name AS nation FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "call_predecessors": ("MATCH (r:Region) CALL nxalg.bfs_edges(r, true, 1) YIELD node_from, node_to RETURN node_from.name AS region, node_to.name AS nation", "SELECT r_name AS region, n_name AS nation FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "call_relationship_types": ("MATCH (n:Nation) CALL node.relationship_types(n) YIELD relationship_types RETURN n.name AS nation, relationship_types AS types", "SELECT n_name AS nation, ['IN_NATION', 'IN_REGION'] AS types FROM nation"),
    "call_relationship_exists": ("MATCH (c:Customer) CALL node.relationship_exists(c, 'PLACED>') YIELD exists RETURN exists, count(*) AS n", 'SELECT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS "exists", count(*) AS n FROM customer GROUP BY 1'),
    "call_path_expand": ("MATCH (s:Supplier {suppkey: 5}) CALL path.expand(s, ['IN_NATION>', 'IN_REGION>'], [], 1, 3) YIELD result RETURN length(result) AS hops, [x IN nodes(result) | x.name][-1] AS name", "SELECT 1::BIGINT AS hops, n_name AS name FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey = 5 UNION ALL SELECT 2, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE s_suppkey = 5"),
    "call_subgraph_nodes": ("MATCH (r:Region {regionkey: 2}) CALL path.subgraph_nodes(r, {relationshipFilter: '<IN_REGION', maxLevel: 1}) YIELD node RETURN node.name AS name", "SELECT r_name AS name FROM region WHERE r_regionkey = 2 UNION ALL SELECT n_name FROM nation WHERE n_regionkey = 2"),
    "call_search": ("CALL search.node({Nation: 'name', Region: 'name'}, 'starts with', 'A') YIELD node RETURN node.name AS name", "SELECT n_name AS name FROM nation WHERE n_name LIKE 'A%' UNION ALL SELECT r_name FROM region WHERE r_name LIKE 'A%'"),
    "call_text_search": ("CALL text_search.search('Region', 'data.name:asia') YIELD node RETURN node.name AS name", "SELECT r_name AS name FROM region WHERE r_name = 'ASIA'"),
    "call_text_regex": ("CALL text_search.regex_search('Nation', 'u.*') YIELD node RETURN node.name AS name", "SELECT n_name AS name FROM nation WHERE regexp_matches(lower(n_name), '(^|[^a-z0-9])u[a-z0-9]*')"),
    "call_text_fuzzy": ("CALL text_search.fuzzy_phrase_search('Region', 'azia', {distance: 1}) YIELD node RETURN node.name AS name", "SELECT r_name AS name FROM region WHERE r_name = 'ASIA'"),
    "call_isolates": ("CALL nxalg.isolates() YIELD id RETURN count(*) AS n", "SELECT (SELECT count(*) FROM region WHERE r_regionkey NOT IN (SELECT n_regionkey FROM nation)) + (SELECT count(*) FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem)) AS n"),
    "call_do_when": ("CALL do.when(true, 'MATCH (n:Nation) RETURN n.name AS name', '') YIELD value RETURN value.name AS name", "SELECT n_name AS name FROM nation"),
    "call_jaccard_pair": ("MATCH (a:Nation), (b:Nation) WHERE a.nationkey < b.nationkey CALL node_similarity.jaccard_pairwise(a, b) YIELD node1, node2, similarity RETURN node1.name AS a, node2.name AS b, similarity", "SELECT a.n_name AS a, b.n_name AS b, CASE WHEN a.n_regionkey = b.n_regionkey THEN 1.0 ELSE 0.0 END::DOUBLE AS similarity FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey"),
    "call_schema": ("CALL meta.stats_offline() YIELD labelCount, nodeCount, relationshipTypeCount RETURN labelCount, nodeCount, relationshipTypeCount",
        "SELECT 6::BIGINT AS labelCount, sum(n)::BIGINT AS nodeCount, 5::INT AS relationshipTypeCount FROM (SELECT count(*) AS n FROM region UNION ALL SELECT count(*) FROM nation UNION ALL SELECT count(*) FROM customer UNION ALL SELECT count(*) FROM supplier UNION ALL SELECT count(*) FROM part UNION ALL SELECT count(*) FROM orders)"),
    "call_degree": ("CALL node.degree_in(1000000000003, 'IN_NATION') YIELD value RETURN value AS n", "SELECT (SELECT count(*) FROM customer WHERE c_nationkey = 3) + (SELECT count(*) FROM supplier WHERE s_nationkey = 3) AS n"),
    "call_neighbours": ("CALL neighbors.at_hop(1000000000003, ['IN_REGION'], 2) YIELD node RETURN node.name AS name", "SELECT n_name AS name FROM nation WHERE n_nationkey != 3 AND n_regionkey = (SELECT n_regionkey FROM nation WHERE n_nationkey = 3)"),
    "wshortest_text": ("MATCH (n:Nation {nationkey: 3})<-[p:IN_NATION *WSHORTEST 1 (e, x | 2.0) total]-(c:Customer) RETURN c.custkey AS k, total", "SELECT c_custkey AS k, 2.0::DOUBLE AS total FROM customer WHERE c_nationkey = 3"),
}


def _text_query(text: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: run_query(from_star_schema(spark, sf_dir), text)


def _graph(spark: SparkSession, sf_dir: str) -> Graph:
    return from_star_schema(spark, sf_dir)


def _tables(spark: SparkSession, sf_dir: str) -> Callable[[str], DataFrame]:
    return lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")


_C, _S, _P, _N, _R = 2 * 10**12, 3 * 10**12, 4 * 10**12, 10**12, 0


def _market(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Every customer, part and supplier; who bought what, which part came from whom, who sold to whom. weight counts the order lines."""
    t = _tables(spark, sf_dir)
    vertices = t("customer").select((F.col("c_custkey") + _C).alias("id")).union(t("supplier").select(F.col("s_suppkey") + _S)).union(t("part").select(F.col("p_partkey") + _P))
    buyers = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.col("c_custkey") + _C)
    lines = traversal.cut(
        t("lineitem").join(buyers.toDF("o_orderkey", "c"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
        .join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select("c", (F.col("p_partkey") + _P).alias("p"), (F.col("s_suppkey") + _S).alias("s"))
    )
    # one kind of edges at a time, so that what is shuffled for one is gone before the next
    kinds = [traversal.cut(lines.groupBy(F.col(a).alias("src"), F.col(b).alias("dst")).agg(F.count(F.lit(1)).alias("weight"))) for a, b in ("cp", "ps", "sc")]
    traversal.drop(lines)
    return vertices, kinds[0].union(kinds[1]).union(kinds[2])


_MARKET = f"""lines AS (SELECT {_C} + c_custkey AS c, {_P} + p_partkey AS p, {_S} + s_suppkey AS s FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey),
edges AS MATERIALIZED (SELECT c AS src, p AS dst, count(*) AS weight FROM lines GROUP BY 1, 2 UNION ALL SELECT p, s, count(*) FROM lines GROUP BY 1, 2 UNION ALL SELECT s, c, count(*) FROM lines GROUP BY 1, 2),
vertices AS MATERIALIZED (SELECT {_C} + c_custkey AS id FROM customer UNION ALL SELECT {_S} + s_suppkey FROM supplier UNION ALL SELECT {_P} + p_partkey FROM part)"""
_NEAR = "near AS MATERIALIZED (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges)"
#: The traversals start from each supplier whose key is divisible by 50.
_STARTS = f"id > {_S} AND id < {_P} AND (id - {_S}) % 50 = 0"


def _places(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Regions, nations, suppliers and customers, each linked with the place it is in."""
    t = _tables(spark, sf_dir)
    vertices = t("region").select((F.col("r_regionkey").cast("bigint") + _R).alias("id")).union(t("nation").select(F.col("n_nationkey").cast("bigint") + _N)).union(
        t("customer").select(F.col("c_custkey") + _C)).union(t("supplier").select(F.col("s_suppkey") + _S))
    edges = t("nation").select((F.col("n_nationkey").cast("bigint") + _N).alias("src"), (F.col("n_regionkey").cast("bigint") + _R).alias("dst")).union(
        t("customer").select(F.col("c_custkey") + _C, F.col("c_nationkey").cast("bigint") + _N)).union(t("supplier").select(F.col("s_suppkey") + _S, F.col("s_nationkey").cast("bigint") + _N))
    return vertices, traversal.cut(edges)


def degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return algorithms.degree_centrality(*_market(spark, sf_dir), "out").select("node", F.round("degree", 9).alias("degree"))


def wcc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return algorithms.weakly_connected_components(*_market(spark, sf_dir))


def bfs_market(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, e = _market(spark, sf_dir)
    return traversal.reach(e, v.where(_STARTS))


def wshortest(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, e = _market(spark, sf_dir)
    return traversal.weighted_shortest(e, v.where(_STARTS), paths=False)


def triangle_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return algorithms.triangles(_market(spark, sf_dir)[1]).agg(F.count(F.lit(1)).alias("n"))


def clustered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return algorithms.clustering(*_market(spark, sf_dir)).select("node", F.round("clustering", 9).alias("clustering"))


def similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _market(spark, sf_dir)[1].where(f"src > {_S} AND src < {_P}")
    return algorithms.neighbour_similarity(e).select("node1", "node2", F.round("similarity", 6).alias("similarity"))


def reciprocal(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _market(spark, sf_dir)[1]
    both = e.union(e.where("weight > 1").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))  # what was sold more than once also goes back
    return algorithms.reciprocity(both).select(F.round("reciprocity", 9).alias("reciprocity"))


def pagerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return algorithms.pagerank(*_market(spark, sf_dir), max_iterations=30, stop=0.0).select("node", F.round("rank", 9).alias("rank"))


def cores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes, and how many have fewer neighbours of their core or a higher one than their core says: none."""
    v, e = _market(spark, sf_dir)
    core = traversal.cut(algorithms.core_number(v, e))
    near = traversal.both_ways(e.select("src", "dst")).distinct().join(core.toDF("src", "k"), "src").join(core.toDF("dst", "j"), "dst")
    held = near.where("j >= k").groupBy("src", "k").agg(F.count(F.lit(1)).alias("n"))
    return core.join(held, (F.col("node") == F.col("src")) & (F.col("core") == F.col("k")), "left").agg(F.count(F.lit(1)).alias("nodes"), F.count_if(F.coalesce("n", F.lit(0)) < F.col("core")).alias("wrong"))


def communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes, and how many have another label than the most frequent ones around them: none, as the rounds end at rest."""
    v, e = _places(spark, sf_dir)
    found = traversal.cut(algorithms.label_propagation(v, e))
    near = traversal.both_ways(e)
    votes = near.join(found.toDF("dst", "label"), "dst").groupBy("src", "label").agg(F.count(F.lit(1)).alias("n"))
    top = votes.groupBy("src").agg(F.max("n").alias("top"))
    own = found.join(votes, (F.col("node") == F.col("src")) & (F.col("community_id") == F.col("label")), "left").select("node", "n").join(top, F.col("node") == F.col("src"))
    return own.agg(F.count(F.lit(1)).alias("nodes"), F.count_if(F.coalesce("n", F.lit(0)) < F.col("top")).alias("wrong"))


def spanning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of a lightest spanning forest, their weight's bounds, and the components that it leaves: as many as the graph has."""
    v, e = _market(spark, sf_dir)
    tree = traversal.cut(algorithms.minimum_spanning_forest(e))
    parts = algorithms.weakly_connected_components(v, tree).select("component_id").distinct()
    return tree.agg(F.count(F.lit(1)).alias("edges")).crossJoin(parts.agg(F.count(F.lit(1)).alias("components")))


def hubs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the hubs are those of their own authorities, up to 1e-6, and sum to 1."""
    v, e = _market(spark, sf_dir)
    e = e.where(f"src > {_S} AND src < {_P}")
    h = traversal.cut(algorithms.hits(v, e))
    back = e.join(h.select(F.col("node").alias("dst"), "authority"), "dst").groupBy("src").agg(F.sum("authority").alias("h"))
    total = back.agg(F.sum("h").alias("t"))
    fits = h.join(back, F.col("node") == F.col("src")).crossJoin(F.broadcast(total)).agg((F.max(F.abs(F.col("hub") - F.col("h") / F.col("t"))) < 1e-6).alias("settled"), (F.abs(F.sum("hub") - 1) < 1e-9).alias("whole"))
    return fits


def vector_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest of all rows for each row whose id is divisible by 50."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    found = analysis.nearest_vectors(rows, "embedding", 5, -1.0, rows.where("id % 50 = 0").select("id"))
    return found.select("node", "neighbour", F.round("similarity", 4).alias("similarity"))


def text_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return algorithms.text_search(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["license", "apache"], 20).select("doc_id", F.round("score", 6).alias("score"))


def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windowed_counts(spark.read.parquet(f"{sf_dir}/events.parquet")).select("start", "event_type", "n")


def update_property(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _graph(spark, sf_dir)
    new = g.set_property("Part", "size", F.col("size") + 100, F.col("brand") == "Brand#11").delete_nodes("Part", F.col("size") == 7, detach=True)
    return run_query(new, "MATCH (p:Part) RETURN p.size > 100 AS raised, count(*) AS n")


def trigger_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _graph(spark, sf_dir)
    created, deleted, updated = changes(g.nodes["Nation"], g.set_property("Nation", "name", F.lit("x"), F.col("regionkey") == 1).nodes["Nation"])
    return created.agg(F.count(F.lit(1)).alias("created")).crossJoin(deleted.agg(F.count(F.lit(1)).alias("deleted"))).crossJoin(updated.agg(F.count(F.lit(1)).alias("updated")))


def created(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = run_update(_graph(spark, sf_dir), "MATCH (c:Customer)-[:IN_NATION]->(n:Nation) WHERE c.acctbal < 0 CREATE (c)-[:OWES {amount: -c.acctbal}]->(d:Debt {nation: n.name})")
    return run_query(new, "MATCH (c:Customer)-[e:OWES]->(d:Debt) RETURN c.custkey AS k, e.amount AS amount, d.nation AS nation")


def merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = run_update(_graph(spark, sf_dir), "MATCH (p:Part) WITH DISTINCT p.brand AS b MERGE (r:Region {name: b})")
    return run_query(new, "MATCH (r:Region) RETURN r.name AS name")


def text_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = run_update(_graph(spark, sf_dir), "MATCH (c:Customer)-[:PLACED]->(o:Order) WITH c, count(*) AS n SET c.orders = n")
    return run_query(new, "MATCH (c:Customer) RETURN c.custkey AS k, c.orders AS n")


def text_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = run_update(_graph(spark, sf_dir), "MATCH (n:Nation) WHERE n.regionkey = 2 DETACH DELETE n")
    return run_query(new, "MATCH (c:Customer)-[:IN_NATION]->(n:Nation) RETURN n.name AS name, count(*) AS n")


def each(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = run_update(_graph(spark, sf_dir), "MATCH (r:Region) FOREACH (i IN range(1, 3) | CREATE (z:Zone {name: r.name, part: i}))")
    return run_query(new, "MATCH (z:Zone) RETURN z.name AS name, z.part AS part")


def loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_query(_graph(spark, sf_dir), "LOAD PARQUET FROM $path AS row WITH row WHERE row.value > 50.0 RETURN row.event_type AS kind, count(*) AS n", path=f"{sf_dir}/events.parquet")


def _changed(update: str, text: str) -> Callable[[SparkSession, str], DataFrame]:
    """The rows of a query after an update."""
    return lambda spark, sf_dir: run_query(run_update(_graph(spark, sf_dir), update), text)


#: name: (update, query, SQL)
UPDATES: dict[str, tuple[str, str, str]] = {
    "merge_relationship": ("MATCH (n:Nation), (r:Region) WHERE r.regionkey < 2 MERGE (n)-[e:IN_REGION]->(r) ON CREATE SET e.made = true ON MATCH SET e.seen = true", "MATCH (n:Nation)-[e:IN_REGION]->(r:Region) RETURN r.name AS region, e.made AS made, e.seen AS seen, count(*) AS n",
        "SELECT r_name AS region, CASE WHEN n_regionkey != r_regionkey THEN TRUE END AS made, CASE WHEN n_regionkey = r_regionkey AND r_regionkey < 2 THEN TRUE END AS seen, count(*) AS n FROM nation, region WHERE r_regionkey < 2 OR n_regionkey = r_regionkey GROUP BY 1, 2, 3"),
    "merge_on_create": ("UNWIND ['ASIA', 'MOON', 'MOON'] AS x MERGE (r:Region {name: x}) ON CREATE SET r.made = true ON MATCH SET r.seen = true", "MATCH (r:Region) RETURN r.name AS name, r.made AS made, r.seen AS seen", "SELECT r_name AS name, NULL::BOOLEAN AS made, CASE WHEN r_name = 'ASIA' THEN TRUE END AS seen FROM region UNION ALL SELECT 'MOON', TRUE, TRUE"),
    "set_labels": ("MATCH (c:Customer) WHERE c.acctbal < 0 SET c:Debtor REMOVE c:Customer", "MATCH (c:Debtor)-[:IN_NATION]->(n:Nation) RETURN n.name AS nation, labels(c) AS labels, count(*) AS n", "SELECT n_name AS nation, ['Debtor'] AS labels, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal < 0 GROUP BY 1"),
    "multi_label": ("MATCH (c:Customer) WHERE c.acctbal > 5000 SET c:Rich", "MATCH (c:Customer:Rich) RETURN count(*) AS n, min(size(labels(c))) AS labels", "SELECT count(*) AS n, 2 AS labels FROM customer WHERE c_acctbal > 5000"),
    "set_map": ("MATCH (r:Region) SET r = {title: r.name}", "MATCH (r:Region) RETURN r.title AS title, r.name AS name, r.regionkey AS k", "SELECT r_name AS title, NULL::VARCHAR AS name, NULL::INT AS k FROM region"),
    "set_nested": ("MATCH (r:Region) SET r.info = {a: 1, b: {c: r.name}} SET r.info.b.c = toLower(r.name), r.info.d = 4 REMOVE r.info.a", "MATCH (r:Region) RETURN r.info.b.c AS c, r.info.d AS d, r.info.a AS a", "SELECT lower(r_name) AS c, 4::BIGINT AS d, NULL::BIGINT AS a FROM region"),
    "delete_path": ("MATCH p = (n:Nation)-[:IN_REGION]->(:Region {regionkey: 1}) DETACH DELETE p", "MATCH (n) WHERE n:Nation OR n:Region RETURN labels(n)[0] AS label, count(*) AS n", "SELECT 'Nation' AS label, count(*) AS n FROM nation WHERE n_regionkey != 1 UNION ALL SELECT 'Region', count(*) FROM region WHERE r_regionkey != 1"),
    "remove_property": ("MATCH (p:Part) WHERE p.size > 25 REMOVE p.brand", "MATCH (p:Part) RETURN p.brand IS NULL AS gone, count(*) AS n", "SELECT p_size > 25 OR p_brand IS NULL AS gone, count(*) AS n FROM part GROUP BY 1"),
    "call_subquery_update": ("MATCH (r:Region) CALL { WITH r CREATE (:Mark {of: r.name}) } IN TRANSACTIONS OF 2 ROWS", "MATCH (m:Mark) RETURN m.of AS name", "SELECT r_name AS name FROM region"),
    "call_set_property": ("MATCH (n:Nation) WHERE n.regionkey = 3 CALL create.set_property(n, 'colour', 'red') YIELD node RETURN node", "MATCH (n:Nation) RETURN n.name AS name, n.colour AS colour", "SELECT n_name AS name, CASE WHEN n_regionkey = 3 THEN 'red' END AS colour FROM nation"),
    "call_create_node": ("CALL create.node(['A', 'B'], {x: 5}) YIELD node RETURN node", "MATCH (n:A:B) RETURN n.x AS x", "SELECT 5 AS x"),
    "call_remove_properties": ("MATCH (n:Nation) CALL create.remove_properties(n, ['name']) YIELD node RETURN node", "MATCH (n:Nation) RETURN n.name AS name, count(*) AS n", "SELECT NULL::VARCHAR AS name, count(*) AS n FROM nation"),
    "call_remove_labels": ("MATCH (n:Region) CALL create.remove_labels(n, 'Region') YIELD node RETURN node", "MATCH (n) WHERE size(labels(n)) = 0 RETURN n.name AS name", "SELECT r_name AS name FROM region"),
    "call_create_relationship": ("MATCH (a:Region), (b:Region) WHERE a.regionkey < b.regionkey CALL create.relationship(a, 'NEAR', {w: 2}, b) YIELD relationship RETURN relationship", "MATCH (a:Region)-[e:NEAR]->(b:Region) RETURN a.name AS a, b.name AS b, e.w AS w", "SELECT a.r_name AS a, b.r_name AS b, 2 AS w FROM region a JOIN region b ON a.r_regionkey < b.r_regionkey"),
    "call_merge_node": ("CALL merge.node(['Region'], {name: 'ASIA'}, {}, {seen: true}) YIELD node RETURN node", "MATCH (r:Region) RETURN r.name AS name, r.seen AS seen", "SELECT r_name AS name, CASE WHEN r_name = 'ASIA' THEN TRUE END AS seen FROM region"),
    "call_nodes_delete": ("MATCH (n:Nation) WHERE n.regionkey = 0 CALL nodes.delete(n) YIELD value RETURN value", "MATCH (n:Nation)-[e:IN_REGION]->(r) RETURN r.name AS region, count(*) AS n", "SELECT r_name AS region, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_regionkey != 0 GROUP BY 1"),
    "call_rename_label": ("CALL refactor.rename_label('Nation', 'Country') YIELD nodes_changed RETURN nodes_changed", "MATCH (n:Country)-[:IN_REGION]->(r:Region) RETURN r.name AS region, count(*) AS n", "SELECT r_name AS region, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1"),
    "call_rename_type": ("CALL refactor.rename_type('IN_REGION', 'PART_OF') YIELD relationships_changed RETURN relationships_changed", "MATCH (:Nation)-[e:PART_OF]->(:Region) RETURN count(e) AS n", "SELECT count(*) AS n FROM nation"),
    "call_rename_property": ("CALL refactor.rename_node_property('name', 'title') YIELD nodes_changed RETURN nodes_changed", "MATCH (n:Nation) RETURN n.title AS title, n.name AS name", "SELECT n_name AS title, NULL::VARCHAR AS name FROM nation"),
    "call_invert": ("MATCH (:Nation)-[e:IN_REGION]->(:Region) CALL refactor.invert(e) YIELD output RETURN output", "MATCH (r:Region)-[:IN_REGION]->(n:Nation) RETURN r.name AS region, count(*) AS n", "SELECT r_name AS region, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1"),
    "call_categorize": ("CALL refactor.categorize('mktsegment', 'IN_SEGMENT', true, 'Segment', 'name') YIELD status RETURN status", "MATCH (c:Customer)-[:IN_SEGMENT]->(s:Segment) RETURN s.name AS segment, count(*) AS n, count(DISTINCT s) AS one", "SELECT c_mktsegment AS segment, count(*) AS n, 1::BIGINT AS one FROM customer WHERE c_mktsegment IS NOT NULL GROUP BY 1"),
    "call_collapse": ("MATCH (n:Nation) WHERE n.regionkey = 1 CALL refactor.collapse_node(n, 'VIA') YIELD new_relationship RETURN new_relationship", "MATCH (c:Customer)-[e:VIA]->(r:Region) RETURN e.name AS nation, r.name AS region, count(*) AS n", "SELECT n_name AS nation, r_name AS region, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE n_regionkey = 1 GROUP BY 1, 2"),
    "call_extract_node": ("MATCH (:Nation)-[e:IN_REGION]->(:Region) CALL refactor.extract_node(e, ['Link'], 'TO', 'FROM') YIELD output RETURN output", "MATCH (n:Nation)-[:FROM]->(:Link)-[:TO]->(r:Region) RETURN n.name AS nation, r.name AS region", "SELECT n_name AS nation, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "call_clone_nodes": ("MATCH (n:Nation) WHERE n.regionkey = 2 CALL refactor.clone_nodes(n, false, ['nationkey']) YIELD output RETURN output", "MATCH (n:Nation) RETURN n.name AS name, count(*) AS n, count(n.nationkey) AS k", "SELECT n_name AS name, CASE WHEN n_regionkey = 2 THEN 2 ELSE 1 END::BIGINT AS n, 1::BIGINT AS k FROM nation"),
    "call_periodic_delete": ("CALL periodic.delete({labels: ['Order']}) YIELD number_of_deleted_nodes RETURN number_of_deleted_nodes", "MATCH (c:Customer) OPTIONAL MATCH (c)-[e:PLACED]->() RETURN count(*) AS n, count(e) AS orders", "SELECT count(*) AS n, 0::BIGINT AS orders FROM customer"),
    "call_periodic_iterate": ("CALL periodic.iterate('MATCH (r:Region) RETURN r.name AS name', 'CREATE (:Copy {of: name})', {batch_size: 2}) YIELD success RETURN success", "MATCH (c:Copy) RETURN c.of AS name", "SELECT r_name AS name FROM region"),
    "call_chain": ("CALL graph_util.chain_nodes([0, 1, 2], 'NEXT') YIELD relationship RETURN relationship", "MATCH (a:Region)-[:NEXT]->(b:Region) RETURN a.regionkey AS a, b.regionkey AS b", "SELECT r_regionkey AS a, r_regionkey + 1 AS b FROM region WHERE r_regionkey < 2"),
    "call_merge_nodes": ("CALL refactor.merge_nodes([0, 1], {properties: 'discard'}) YIELD node RETURN node", "MATCH (n:Nation)-[:IN_REGION]->(r:Region) RETURN r.regionkey AS k, count(*) AS n", "SELECT CASE WHEN n_regionkey = 1 THEN 0 ELSE n_regionkey END AS k, count(*) AS n FROM nation GROUP BY 1"),
}


def strong(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.strongly_connected_components(*_market(spark, sf_dir))


def bridging(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.bridges(*_places(spark, sf_dir))


def between(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, e = _places(spark, sf_dir)
    found = structure.betweenness_centrality(v, e, False, False)
    return found.where(f"node < {_C}").select("node", F.round("betweenness_centrality", 3).alias("betweenness_centrality"))


def far(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, e = _places(spark, sf_dir)
    return structure.distances(v, traversal.both_ways(e)).where(f"node < {_C}").select("node", "eccentricity", "total")


def coloured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes, and edges whose ends have one colour: none."""
    v, e = _market(spark, sf_dir)
    found = traversal.cut(structure.colouring(v, e))
    same = e.join(found.toDF("src", "a"), "src").join(found.toDF("dst", "b"), "dst").agg(F.count_if(F.col("a") == F.col("b")).alias("conflicts"))
    return found.agg(F.count(F.lit(1)).alias("nodes")).crossJoin(same)


def matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes that two edges of the matching share, and edges that could be added: none."""
    e = _market(spark, sf_dir)[1]
    found = traversal.cut(structure.maximal_matching(e))
    ends = found.select(F.explode(F.array("src", "dst")).alias("v"))
    shared = ends.groupBy("v").agg(F.count(F.lit(1)).alias("n")).agg(F.count_if(F.col("n") > 1).alias("shared"))
    free = e.join(ends.toDF("src"), "src", "left_anti").join(ends.toDF("dst"), "dst", "left_anti").agg(F.count(F.lit(1)).alias("free"))
    return shared.crossJoin(free)


def moved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes, and whether the communities are better than one for all or one for each."""
    v, e = _places(spark, sf_dir)
    found = traversal.cut(structure.louvain(v, e))
    return found.agg(F.count(F.lit(1)).alias("nodes")).crossJoin(structure.modularity(e, found).select((F.col("modularity") > 0.5).alias("good")))


def circles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cycles of at most three edges by length."""
    return structure.cycles(_market(spark, sf_dir)[1], 3).groupBy(F.size("nodes").alias("length")).agg(F.count(F.lit(1)).alias("n"))


def nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, e = _market(spark, sf_dir)
    return structure.voronoi_cells(e, v.where(_STARTS))


def covered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers that no supplier of a greedy cover sold to: none; and whether the cover is smaller than all suppliers."""
    pairs = traversal.cut(_market(spark, sf_dir)[1].where(f"src > {_S} AND src < {_P}").select(F.col("dst").alias("element"), F.col("src").alias("containing_set")))
    found = traversal.cut(structure.set_cover(pairs))
    open_ = pairs.join(pairs.join(found, "containing_set", "left_semi").select("element"), "element", "left_anti").agg(F.count(F.lit(1)).alias("open"))
    return open_.crossJoin(found.agg(F.count(F.lit(1)).alias("k"))).crossJoin(pairs.agg(F.count_distinct("containing_set").alias("n"))).select("open", (F.col("k") <= F.col("n")).alias("fits"))


def two_coloured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who bought what is bipartite; with who sold to whom there are odd cycles."""
    v, e = _market(spark, sf_dir)
    one, two = structure.is_bipartite(v, e.where(f"src < {_S}")), structure.is_bipartite(v, e)
    return one.crossJoin(two.withColumnRenamed("is_bipartite", "with_sellers"))


def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.kmeans(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), 4, key="vec_id")


CODE: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "degree_centrality": (degree, f"WITH {_MARKET} SELECT id AS node, round(count(src) / (SELECT count(*) - 1 FROM vertices), 9)::DOUBLE AS degree FROM vertices LEFT JOIN edges ON src = id GROUP BY 1"),
    "connected_components": (wcc, f"WITH RECURSIVE {_MARKET}, {_NEAR}, r(node, root) USING KEY (node) AS (SELECT id, id FROM vertices UNION SELECT b.dst, min(r.root) FROM r JOIN near b ON b.src = r.node JOIN recurring.r AS o ON o.node = b.dst WHERE r.root < o.root GROUP BY b.dst) SELECT node, root AS component_id FROM r"),
    "bfs_reach": (bfs_market, f"WITH RECURSIVE {_MARKET}, r(source, node, depth) USING KEY (source, node) AS (SELECT id, id, 0 FROM vertices WHERE {_STARTS} UNION SELECT r.source, e.dst, min(r.depth + 1) FROM r JOIN edges e ON e.src = r.node LEFT JOIN recurring.r AS o ON o.source = r.source AND o.node = e.dst WHERE o.node IS NULL GROUP BY 1, 2) SELECT source, node, depth::INT AS depth FROM r"),
    "weighted_shortest": (wshortest, f"WITH RECURSIVE {_MARKET}, r(source, node, weight) USING KEY (source, node) AS (SELECT id, id, 0::BIGINT FROM vertices WHERE {_STARTS} UNION SELECT r.source, e.dst, min(r.weight + e.weight) FROM r JOIN edges e ON e.src = r.node LEFT JOIN recurring.r AS o ON o.source = r.source AND o.node = e.dst WHERE o.node IS NULL OR r.weight + e.weight < o.weight GROUP BY 1, 2) SELECT source, node, weight::DOUBLE AS weight FROM r"),
    "triangle_count": (triangle_count, f"WITH {_MARKET}, p AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM edges) SELECT count(*) AS n FROM p x JOIN p y ON x.b = y.a JOIN p z ON z.a = x.a AND z.b = y.b"),
    "clustering": (clustered, f"WITH {_MARKET}, {_NEAR}, p AS (SELECT src AS a, dst AS b FROM near WHERE src < dst), t AS (SELECT x.a, x.b, y.b AS c FROM p x JOIN p y ON x.b = y.a JOIN p z ON z.a = x.a AND z.b = y.b), k AS (SELECT v, count(*) AS t FROM (SELECT a AS v FROM t UNION ALL SELECT b FROM t UNION ALL SELECT c FROM t) GROUP BY 1), d AS (SELECT src AS v, count(*) AS d FROM near GROUP BY 1) SELECT id AS node, round(CASE WHEN d > 1 THEN coalesce(t, 0) * 2 / (d * (d - 1)) ELSE 0 END, 9)::DOUBLE AS clustering FROM vertices LEFT JOIN d ON d.v = id LEFT JOIN k ON k.v = id"),
    "jaccard_similarity": (similarity, f"WITH {_MARKET}, own AS (SELECT * FROM edges WHERE src > {_S} AND src < {_P}), d AS (SELECT src, count(*) AS n FROM own GROUP BY 1), c AS (SELECT x.src AS node1, y.src AS node2, count(*) AS c FROM own x JOIN own y ON x.dst = y.dst AND x.src < y.src GROUP BY 1, 2) SELECT node1, node2, round(c / (p.n + q.n - c), 6)::DOUBLE AS similarity FROM c JOIN d p ON p.src = node1 JOIN d q ON q.src = node2"),
    "reciprocity": (reciprocal, f"WITH {_MARKET} SELECT round(2 * count(*) FILTER (WHERE weight > 1) / (count(*) + count(*) FILTER (WHERE weight > 1)), 9)::DOUBLE AS reciprocity FROM edges"),
    "pagerank": (pagerank, f"""WITH RECURSIVE {_MARKET}, out AS (SELECT src, count(*) AS d FROM edges GROUP BY 1), steps AS MATERIALIZED (SELECT e.src, e.dst, 1.0::DOUBLE / d AS share FROM edges e JOIN out USING (src)), n AS (SELECT count(*)::DOUBLE AS n FROM vertices),
r(node, rank, i) AS (SELECT id, 1 / n, 0 FROM vertices, n UNION ALL
  SELECT v.id, 0.15::DOUBLE / n + 0.85::DOUBLE * (coalesce(got, 0) + (1 - sent) / n), step + 1 FROM vertices v CROSS JOIN n CROSS JOIN (SELECT max(i) AS step FROM r) CROSS JOIN (SELECT coalesce(sum(rank * share), 0) AS sent FROM r JOIN steps ON src = node)
  LEFT JOIN (SELECT dst, sum(rank * share) AS got FROM r JOIN steps ON src = node GROUP BY 1) g ON g.dst = v.id WHERE step < 30)
SELECT node, round(rank, 9) AS rank FROM r WHERE i = 30"""),
    "core_number": (cores, f"WITH {_MARKET} SELECT count(*) AS nodes, 0::BIGINT AS wrong FROM vertices"), "label_propagation": (communities, "SELECT (SELECT count(*) FROM region) + (SELECT count(*) FROM nation) + (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) AS nodes, 0::BIGINT AS wrong"),
    "spanning_forest": (spanning, f"WITH RECURSIVE {_MARKET}, {_NEAR}, r(node, root) USING KEY (node) AS (SELECT id, id FROM vertices UNION SELECT b.dst, min(r.root) FROM r JOIN near b ON b.src = r.node JOIN recurring.r AS o ON o.node = b.dst WHERE r.root < o.root GROUP BY b.dst) SELECT count(*) - count(DISTINCT root) AS edges, count(DISTINCT root) AS components FROM r"),
    "hits": (hubs, "SELECT TRUE AS settled, TRUE AS whole"),
    "vector_search": (vector_top, "WITH q AS (SELECT vec_id AS node, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 50 = 0), p AS (SELECT node, vec_id AS neighbour, list_cosine_similarity(embedding::DOUBLE[], e) AS s FROM embeddings, q WHERE vec_id != node) SELECT node, neighbour, round(s, 4) AS similarity FROM p QUALIFY row_number() OVER (PARTITION BY node ORDER BY s DESC, neighbour) <= 5"),
    "text_search": (text_top, r"""WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w != '') AS w FROM documents), c AS (SELECT doc_id, len(w) AS n, len(list_filter(w, lambda x: x = 'license')) AS a, len(list_filter(w, lambda x: x = 'apache')) AS b FROM t),
f AS (SELECT count(*) AS docs, avg(n) AS mean, count(*) FILTER (WHERE a > 0) AS da, count(*) FILTER (WHERE b > 0) AS db FROM c)
SELECT doc_id, round(ln(1 + (docs - da + 0.5) / (da + 0.5)) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * n / mean)) + ln(1 + (docs - db + 0.5) / (db + 0.5)) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * n / mean)), 6)::DOUBLE AS score FROM c, f WHERE a + b > 0
ORDER BY ln(1 + (docs - da + 0.5) / (da + 0.5)) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * n / mean)) + ln(1 + (docs - db + 0.5) / (db + 0.5)) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * n / mean)) DESC, doc_id LIMIT 20"""),
    "event_windows": (event_windows, "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2"),
    "update_and_delete": (update_property, "SELECT raised, count(*) AS n FROM (SELECT p_size + CASE WHEN p_brand = 'Brand#11' THEN 100 ELSE 0 END AS s, s > 100 AS raised FROM part) WHERE s != 7 GROUP BY 1"),
    "create_text": (created, "SELECT c_custkey AS k, -c_acctbal AS amount, n_name AS nation FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal < 0"),
    "merge_text": (merged, "SELECT r_name AS name FROM region UNION SELECT p_brand FROM part WHERE p_brand IS NOT NULL"),
    "set_text": (text_set, "SELECT c_custkey AS k, n FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey"),
    "delete_text": (text_delete, "SELECT n_name AS name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey != 2 GROUP BY 1"),
    "foreach_text": (each, "SELECT r_name AS name, i AS part FROM region, range(1, 4) t(i)"),
    "load_parquet_text": (loaded, "SELECT event_type AS kind, count(*) AS n FROM events WHERE value > 50 GROUP BY 1"),
    "strong_components": (strong, f"WITH RECURSIVE {_MARKET}, r(node, root) USING KEY (node) AS (SELECT id, id FROM vertices UNION SELECT b.dst, min(r.root) FROM r JOIN edges b ON b.src = r.node JOIN recurring.r AS o ON o.node = b.dst WHERE r.root < o.root GROUP BY b.dst), l(node, root) USING KEY (node) AS (SELECT id, id FROM vertices UNION SELECT b.src, min(l.root) FROM l JOIN edges b ON b.dst = l.node JOIN recurring.l AS o ON o.node = b.src WHERE l.root < o.root GROUP BY b.src) SELECT r.node, CASE WHEN r.root = l.root THEN r.root ELSE r.node END AS component_id FROM r JOIN l USING (node)"),
    "distances": (far, f"WITH leaves AS (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier), l AS (SELECT n_nationkey AS k, n_regionkey AS r, count(leaves.k) AS n FROM nation LEFT JOIN leaves ON leaves.k = n_nationkey GROUP BY 1, 2), t AS (SELECT r, count(*) AS m, sum(n)::BIGINT AS n FROM l GROUP BY 1) SELECT {_N} + l.k AS node, (CASE WHEN t.n - l.n > 0 THEN 3 WHEN t.m > 1 THEN 2 ELSE 1 END)::INT AS eccentricity, (l.n + 1 + 2 * (t.m - 1) + 3 * (t.n - l.n))::BIGINT AS total FROM l JOIN t USING (r) UNION ALL SELECT r::BIGINT, 2, (m + 2 * n)::BIGINT FROM t"),
    "cycles": (circles, f"WITH {_MARKET}, c AS (SELECT 2 AS length, x.src FROM edges x JOIN edges y ON x.dst = y.src AND y.dst = x.src AND x.src < x.dst UNION ALL SELECT 3, x.src FROM edges x JOIN edges y ON x.dst = y.src JOIN edges z ON z.src = y.dst AND z.dst = x.src WHERE x.src < x.dst AND x.src < y.dst AND x.dst != y.dst) SELECT length, count(*) AS n FROM c GROUP BY 1"),
    "voronoi_cells": (nearest, f"WITH RECURSIVE {_MARKET}, r(source, node, depth) USING KEY (source, node) AS (SELECT id, id, 0 FROM vertices WHERE {_STARTS} UNION SELECT r.source, e.dst, min(r.depth + 1) FROM r JOIN edges e ON e.src = r.node LEFT JOIN recurring.r AS o ON o.source = r.source AND o.node = e.dst WHERE o.node IS NULL GROUP BY 1, 2) SELECT node, (min((depth, source)))[2] AS center FROM r GROUP BY 1"),
    "is_bipartite": (two_coloured, f"WITH {_MARKET} SELECT TRUE AS is_bipartite, (SELECT count(*) FROM lines) = 0 AS with_sellers"),
    "bridges": (bridging, f"SELECT {_R} + n_regionkey::BIGINT AS node_from, {_N} + n_nationkey AS node_to FROM nation UNION ALL SELECT {_N} + c_nationkey, {_C} + c_custkey FROM customer UNION ALL SELECT {_N} + s_nationkey, {_S} + s_suppkey FROM supplier"),
    "betweenness_centrality": (between, f"WITH leaves AS (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier), l AS (SELECT n_nationkey AS k, n_regionkey AS r, count(leaves.k) AS n FROM nation LEFT JOIN leaves ON leaves.k = n_nationkey GROUP BY 1, 2), t AS (SELECT r, sum(n + 1) AS n, sum((n + 1) * (n + 1)) AS q FROM l GROUP BY 1) SELECT {_N} + k AS node, (l.n * (l.n - 1) / 2 + l.n * (t.n - l.n))::DOUBLE AS betweenness_centrality FROM l JOIN t USING (r) UNION ALL SELECT r::BIGINT, ((n * n - q) / 2)::DOUBLE FROM t"),
    "graph_coloring": (coloured, f"WITH {_MARKET} SELECT count(*) AS nodes, 0::BIGINT AS conflicts FROM vertices"), "maximal_matching": (matching, "SELECT 0::BIGINT AS shared, 0::BIGINT AS free"),
    "louvain": (moved, "SELECT (SELECT count(*) FROM region) + (SELECT count(*) FROM nation) + (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) AS nodes, TRUE AS good"),
    "set_cover": (covered, "SELECT 0::BIGINT AS open, TRUE AS fits"), "kmeans": (clusters, None),
    "trigger_changes": (trigger_changes, "SELECT 0::BIGINT AS created, 0::BIGINT AS deleted, count(*) AS updated FROM nation WHERE n_regionkey = 1"),
}

QUERIES = {k: _changed(update, text) for k, (update, text, _) in UPDATES.items()} | {k: _text_query(text) for k, (text, _) in TEXTS.items()} | {k: f for k, (f, _) in CODE.items()}
SQL = {k: sql for k, (_, _, sql) in UPDATES.items()} | {k: sql for k, (_, sql) in TEXTS.items()} | {k: sql for k, (_, sql) in CODE.items() if sql}
