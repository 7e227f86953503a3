"""Query of the URL filter over all pages."""

from flowguard.llm.common import table
from flowguard.llm.registry import query
from flowguard.llm.url_filter import UrlRule, judge

RULES = (UrlRule("org", "/", "allow"), UrlRule("example.org", "/es/", "block"),
         UrlRule("example.org", "/en/1", "block"), UrlRule("com", "/fr/", "allow"),
         UrlRule("com", "/de/", "block"))


@query("op1_url_filter")
def op1(spark, sf):
    return judge(table(spark, sf, "pages"), RULES)
