"""The utility library as SQL templates under qualified names; arguments as in names.py."""

_EARTH_METRES = 6371000.0
_HAVERSINE = (
    f"(2 * {_EARTH_METRES}D * asin(sqrt(pow(sin(radians({{1}}.latitude - {{0}}.latitude) / 2), 2)"
    " + cos(radians({0}.latitude)) * cos(radians({1}.latitude)) * pow(sin(radians({1}.longitude - {0}.longitude) / 2), 2))))"
)
_DOT = "aggregate(zip_with({0}, {1}, (x, y) -> cast(x as double) * y), 0D, (a, x) -> a + x)"

LIBRARY: dict[str, str] = {
    # collections
    "collections.sum": "aggregate({0}, 0D, (a, x) -> a + cast(x as double))",
    "collections.sum_longs": "aggregate({0}, 0L, (a, x) -> a + cast(x as bigint))",
    "collections.avg": "(case when size({0}) > 0 then aggregate({0}, 0D, (a, x) -> a + cast(x as double)) / size({0}) end)",
    "collections.max": "array_max({0})", "collections.min": "array_min({0})", "collections.sort": "array_sort({0})",
    "collections.contains": "array_contains({0}, {1})", "collections.contains_sorted": "array_contains({0}, {1})",
    "collections.contains_all": "(size(array_except({1}, {0})) = 0)", "collections.intersection": "array_intersect({0}, {1})",
    "collections.union": "array_union({0}, {1})", "collections.union_all": "concat({0}, {1})",
    "collections.remove_all": "filter({0}, x -> not array_contains({1}, x))", "collections.subtract": "array_except({0}, {1})",
    "collections.to_set": "array_distinct({0})", "collections.flatten": "flatten({0})",
    "collections.disjunction": "array_union(array_except({0}, {1}), array_except({1}, {0}))",
    "collections.duplicates": "array_distinct(filter({0}, x -> size(filter({0}, y -> y <=> x)) > 1))",
    "collections.frequencies_as_map": "map_from_entries(transform(array_distinct(array_compact({0})), x -> struct(x, cast(size(filter({0}, y -> y = x)) as bigint))))",
    "collections.pairs": "transform({0}, (x, i) -> array(x, try_element_at({0}, i + 2)))",
    "collections.partition": "(case when size({0}) = 0 then array() else transform(sequence(0, cast((size({0}) - 1) div {1} as int)), i -> slice({0}, cast(i * {1} + 1 as int), cast({1} as int))) end)",
    "collections.split": "filter(transform(filter(sequence(0, size({0})), i -> i = 0 or {0}[i - 1] <=> {1}), i -> slice({0}, i + 1, cast(coalesce(try_element_at(filter(sequence(i, size({0})), j -> j = size({0}) or {0}[j] <=> {1}), 1), 0) - i as int))), p -> size(p) > 0)",
    # maps
    "map.from_pairs": "map_from_entries(transform({0}, p -> struct(p[0], p[1])))", "map.from_lists": "map_from_arrays({0}, {1})",
    "map.from_values": "map_from_arrays(filter({0}, (x, i) -> i % 2 = 0), filter({0}, (x, i) -> i % 2 = 1))",
    "map.set_key": "map_concat(map_filter({0}, (k, v) -> k != {1}), map({1}, {2}))", "map.remove_key": "map_filter({0}, (k, v) -> k != {1})",
    "map.remove_keys": "map_filter({0}, (k, v) -> not array_contains({1}, k))", "map.merge": "map_concat(map_filter({0}, (k, v) -> not array_contains(map_keys({1}), k)), {1})",
    "map.get": "coalesce(try_element_at({0}, {1}), {2})",
    "map.merge_list": "aggregate(slice({0}, 2, size({0})), {0}[0], (a, m) -> map_concat(map_filter(a, (k, v) -> not array_contains(map_keys(m), k)), m))",
    # text
    "text.join": "array_join({0}, {1})", "text.replace": "replace({0}, {1}, {2})", "text.regreplace": "regexp_replace({0}, {1}, {2})",
    "text.distance": "cast(levenshtein({0}, {1}) as bigint)", "text.indexof": "cast(locate({1}, {0}) - 1 as bigint)",
    "text.regexgroups": "regexp_extract_all({0}, {1}, 0)", "text.format": "format_string(replace({0}, '{{}}', '%s'), {rest})",
    "text.compare_cleaned": "(regexp_replace(lower({0}), '[^\\\\p{{L}}\\\\p{{N}}]', '') = regexp_replace(lower({1}), '[^\\\\p{{L}}\\\\p{{N}}]', ''))",
    # numbers, identifiers, conversions
    "math.round": "round(cast({0} as double), cast({1} as int))", "util.md5": "md5(array_join(transform({0}, x -> cast(x as string)), ''))", "uuid.get": "uuid()",
    "convert.to_json": "to_json({0})", "json_util.to_json": "to_json({0})", "convert.str2object": "parse_json({0})",
    "convert.from_json_map": "from_json({0}, 'map<string,string>')", "convert.to_map": "from_json(to_json({0}), 'map<string,string>')",
    "convert.from_json_list": "from_json({0}, 'array<string>')", "json_util.from_json_list": "from_json({0}, 'array<string>')", "json_util.load_from_str": "parse_json({0})",
    "label.exists": "array_contains({0}.labels, {1})",
    # time
    "date.parse": "unix_millis(to_timestamp({0}, {1}))", "date.format": "date_format(timestamp_millis({0}), {1})",
    "date.convert_format": "date_format(to_timestamp({0}, {1}), {2})", "temporal.format": "date_format({0}, {1})",
    "date.add": "({0} + cast({1} * (case {2} when 'd' then 86400000L when 'h' then 3600000L when 'm' then 60000L when 's' then 1000L else 1L end) as bigint))",
    # points and vectors
    "distance_calculator.single": _HAVERSINE,
    "vector_search.cosine_similarity": f"({_DOT} / (sqrt({_DOT.replace('{1}', '{0}')}) * sqrt({_DOT.replace('{0}', '{1}')})))",
}
