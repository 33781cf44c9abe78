"""The registered query of hint validation: hints detected on made trees, and stored with faults, with SQL for the faults."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.operators import validation
from foliant.plans import evaluation as E
from foliant.plans.made import chosen, chosen_sql
from foliant.plans.registry import query

KEYS = ["doc"]
KINDS = ("subtitle", "section_heading", "strong_label", "sentence_break", "line_break")
_kind = "l_partkey % 5"


def _hints(t) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(stored, detected, targets): detected hints name every other line, and some sections; stored ones lack some, have more,
    repeat some, and tell some evidence otherwise."""
    li = E._lines(t).withColumn("kind", chosen(KINDS, _kind))
    kind, path, size, weight = F.col("kind"), F.col("path"), F.col("l_quantity") / 2, F.col("l_suppkey")
    one = lambda when, kind=kind, path=path, size=size, weight=weight: F.when(F.expr(when), F.struct(kind.alias("kind"), path.alias("path"), size.alias("size"), weight.alias("weight")))
    hints = lambda *some: li.select("doc", F.explode(F.array_compact(F.array(*some))).alias("h")).select("doc", "h.*")
    section = one("n = 3", F.lit("section_heading"), F.slice("path", 1, 1))
    shifted = F.when(weight % 9 == 0, size + 0.5).otherwise(size + 1e-9)
    told = one("n % 2 = 0 and l_quantity <> 7", size=shifted, weight=F.when(shifted > 24.9, weight + 1).otherwise(weight))
    more, again, lost = one("n % 2 = 1 and l_quantity = 8", F.lit("strong_label")), one("n % 2 = 0 and l_quantity = 9"), one("l_quantity = 10", F.lit("subtitle"), F.array(F.lit(99), F.col("n")))
    targets = li.select("doc", F.explode(F.array("path", F.slice("path", 1, 1))).alias("path")).withColumn("kind", F.explode(F.array(*map(F.lit, KINDS))))
    return hints(told, more, again, lost, section), hints(one("n % 2 = 0"), section), targets


HINTS = f"""{E.LINES}, lk AS (SELECT *, {chosen_sql(KINDS, _kind)} AS kind FROM li), tp AS (SELECT doc, 'section_heading' AS kind, path[1:1] AS path, l_quantity / 2 AS size, l_suppkey AS weight FROM lk WHERE n = 3),
de AS (SELECT doc, kind, path, l_quantity / 2 AS size, l_suppkey AS weight FROM lk WHERE n % 2 = 0 UNION ALL SELECT * FROM tp),
so AS (SELECT doc, kind, path, size, CASE WHEN size > 24.9 THEN weight + 1 ELSE weight END AS weight FROM (SELECT doc, kind, path, CASE WHEN l_suppkey % 9 = 0 THEN l_quantity / 2 + 0.5 ELSE l_quantity / 2 + 1e-9 END AS size, l_suppkey AS weight FROM lk WHERE n % 2 = 0 AND l_quantity <> 7)
  UNION ALL SELECT doc, 'strong_label', path, l_quantity / 2, l_suppkey FROM lk WHERE n % 2 = 1 AND l_quantity = 8 UNION ALL SELECT doc, kind, path, l_quantity / 2, l_suppkey FROM lk WHERE n % 2 = 0 AND l_quantity = 9
  UNION ALL SELECT doc, 'subtitle', [99, n], l_quantity / 2, l_suppkey FROM lk WHERE l_quantity = 10 UNION ALL SELECT * FROM tp),
bk AS (SELECT DISTINCT doc, kind, path FROM so WHERE kind IN ('subtitle', 'section_heading', 'strong_label'))"""


@query(f"""WITH {HINTS}, f AS (SELECT DISTINCT doc, kind, path, 'unresolved' AS fault FROM so WHERE path[1] = 99
UNION ALL SELECT doc, kind, path, 'repeated' FROM so GROUP BY 1, 2, 3 HAVING count(*) > 1
UNION ALL SELECT DISTINCT x.doc, x.kind, x.path, 'overlap' FROM bk x JOIN bk y ON x.doc = y.doc AND x.path[1:len(y.path)] = y.path AND (len(y.path) < len(x.path) OR x.kind <> y.kind)
UNION ALL SELECT DISTINCT doc, kind, path, 'missing' FROM de ANTI JOIN so USING (doc, kind, path) UNION ALL SELECT DISTINCT doc, kind, path, 'extra' FROM so ANTI JOIN de USING (doc, kind, path)
UNION ALL SELECT DISTINCT doc, kind, path, 'evidence:size' FROM so JOIN de USING (doc, kind, path) WHERE abs(so.size - de.size) > 1e-6
UNION ALL SELECT DISTINCT doc, kind, path, 'evidence:weight' FROM so JOIN de USING (doc, kind, path) WHERE so.weight <> de.weight)
SELECT doc, kind, array_to_string(path, '.') AS path, fault FROM f""")
def hint_faults(t) -> DataFrame:
    faults = validation.hint_faults(*_hints(t), KEYS, ["size"], ["weight"])
    return faults.withColumn("path", F.array_join(F.transform("path", lambda x: x.cast("string")), "."))
