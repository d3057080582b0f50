"""Built-in functions of the query language as SQL templates; {0}, {1} ... are the arguments, {all} all of them, {rest} all but the first.

What depends on the arguments' types is written in plans/expression.py.
"""

from .library import LIBRARY

FUNCTIONS: dict[str, str] = LIBRARY | {
    **{n: n + "({all})" for n in ("abs", "acos", "asin", "atan", "atan2", "cos", "exp", "sin", "sqrt", "tan", "e", "pi", "rand", "coalesce", "reverse", "trim", "right", "left", "replace", "round", "degrees", "radians")},
    "ceil": "cast(ceil({0}) as double)", "floor": "cast(floor({0}) as double)", "sign": "cast(signum({0}) as int)",
    "log": "(case when {0} < 0 then double('NaN') when {0} = 0 then double('-Infinity') else ln({0}) end)",
    "log10": "(case when {0} < 0 then double('NaN') when {0} = 0 then double('-Infinity') else log10({0}) end)",
    "toboolean": "(case lower(cast({0} as string)) when 'true' then true when 'false' then false end)",
    "tofloat": "try_cast({0} as double)", "head": "try_element_at({0}, 1)", "last": "try_element_at({0}, -1)",
    "tail": "slice({0}, 2, greatest(size({0}) - 1, 0))", "toset": "array_distinct({0})",
    "tolower": "lower({0})", "toupper": "upper({0})", "ltrim": "ltrim({0})", "rtrim": "rtrim({0})",
    "split": "split({0}, concat('\\\\Q', {1}, '\\\\E'), -1)", "labels": "{0}.labels", "type": "{0}.type", "elementid": "cast({0}.id as string)",
    "isempty": "(size({0}) = 0)", "assert": "(assert_true({all}) is null)",
}
#: {0} and {1} are the arguments, {d} DISTINCT, {live} the filter that leaves out the rows which only stand for a subquery's caller.
AGGREGATES: dict[str, str] = {
    "count": "count({d}{0}){live}", "sum": "coalesce(sum({d}{0}){live}, 0)", "avg": "avg({d}{0}){live}", "min": "min({0}){live}", "max": "max({0}){live}", "collect": "{collect}({0}){live}",
    "stdev": "stddev_samp({0}){live}", "stdevp": "stddev_pop({0}){live}", "percentilecont": "percentile({0}, {1}){live}", "project": "", "derive": "",
}
