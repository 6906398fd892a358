"""Queries of reports for readers over the results of the corpus check."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trivalent.operators import check, report_document
from trivalent.queries import rules

LABELS = {"ATTRIBUTE_VALUE_MISMATCH": "another value | than asked", "ATTRIBUTE_EMPTY": "no value", "SCHEMA_MISMATCH": "made for another schema", "NO_SUBJECTS_AND_PROHIBITED": "none, as asked"}
LISTED = 3


def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, specs = rules.facts(spark, sf_dir), rules.specifications(spark)
    results = rules.results(spark, sf_dir)
    outcomes = check.entity_outcomes(own, specs, check.subjects_of(own, specs))
    items = check.itemised(outcomes, ["model", "ids", "ordinal"], ["entity_id"], LISTED)
    return report_document.report_lines(results, check.report(results), items, LABELS)


def report_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report_document.documents(report_lines(spark, sf_dir)).select("model", F.length("markdown").alias("length"), "sha256")


QUERIES = {"report_lines": report_lines, "report_documents": report_documents}
_LABEL = "case reason_code {} else reason_code end".format(" ".join(f"when '{k}' then '{v.replace('|', chr(92) + '|')}'" for k, v in LABELS.items()))
_LINES = f"""with res as ({rules.RESULTS}), rep as ({rules.REPORT}), outc as ({rules.OUTCOMES}), n as (select *, row_number() over (partition by model order by ordinal) as section, {_LABEL} as label, reason_code in ('SCHEMA_MISMATCH', 'NO_SUBJECTS_NOTHING_CHECKED', 'NO_REQUIREMENTS_NOTHING_ASSERTED') as nothing from res),
 o as (select model, ordinal, entity_id, status, reason_code, {_LABEL} as label from outc union all select model, 5, entity_id, status, reason_code, {_LABEL} from outc where ordinal = 0),
 bad as (select *, row_number() over w as rank, greatest(0, count(*) over (partition by model, ordinal) - {LISTED}) as omitted from o where status <> 'PASS' window w as (partition by model, ordinal order by entity_id) qualify rank <= {LISTED}),
 i as (select bad.*, section from bad join n using (model, ordinal)), t as (select model, section, max(omitted) as omitted, max(rank) as last from i group by 1, 2),
 h as (select model, 0 as section, unnest([0, 1, 2, 3, 4]) as place, unnest(['# Report on ' || model, '', 'Made from the model ' || model || ' and ' || (select count(*) from n where n.model = rep.model) || ' specifications. What was not evaluated is undecided, not compliant.', '',
   '**' || status || '**: ' || specifications_passed || ' specifications passed, ' || specifications_failed || ' failed, ' || specifications_indeterminate || ' undecided.']) as line from rep),
 b as (select model, section, unnest([0, 1, 2, 3, 4, 5]) as place, unnest(['', '## ' || section || '. ' || name, '', status || if(label is null, '', ' (' || label || ')'), if(coalesce(nothing, false), 'Nothing was established here.', null), if(matched > 0, matched || ' matched: ' || passed || ' passed, ' || failed || ' failed, ' || indeterminate || ' undecided.', null)]) as line from n),
 every as (select * from h union all select * from b where line is not null union all select model, section, unnest([100, 101, 102]), unnest(['', '| Element | Status | Reason |', '|---|---|---|']) from t
  union all select model, section, rank + 102, '| ' || entity_id || ' | ' || status || ' | ' || coalesce(label, '') || ' |' from i union all select model, section, last + 103, omitted || ' more are not listed.' from t where omitted > 0)"""
ORACLES = {
    "report_lines": f"{_LINES} select * from every",
    "report_documents": f"{_LINES}, d as (select model, string_agg(line, e'\\n' order by section, place) || e'\\n' as m from every group by 1) select model, length(m) as length, sha256(m) as sha256 from d",
}
