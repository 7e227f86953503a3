"""Query of benchmark decontamination over all documents."""

from flowguard.llm.common import table
from flowguard.llm.decontamination import contaminated
from flowguard.llm.registry import query


@query("op5_decontamination")
def op5(spark, sf):
    return contaminated(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
