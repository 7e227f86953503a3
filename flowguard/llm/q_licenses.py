"""Query of the license scan over all documents."""

from flowguard.llm.common import table
from flowguard.llm.licenses import scan
from flowguard.llm.registry import query


@query("op2_license_scan")
def op2(spark, sf):
    return scan(table(spark, sf, "documents"))
