"""Which pages a crawl gets to: list pages by following links until no new one is found, and what the list pages point to.

Fetching stays outside: pages and their links are tables. Each step joins only the nodes that the last one found, and drops those that
were met before; what it leaves is a table, so lineage doesn't grow and a lost executor loses nothing.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.sources import html
from corpusloom.sources.sinks import held


def same_page(url: Column) -> Column:
    """A URL as a key: http for https, without its fragment."""
    return F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "(?i)^https://", "http://")


def probes(start: Column, names: Sequence[str], most: int) -> Column:
    """Array of a list's URL and its guesses: pages 1 to ``most`` under each parameter name, page by page; ``most`` of 0 gives the URL alone."""
    joint = F.when(start.contains("?"), "&").otherwise("?")
    guess = lambda page, name: F.concat(start, joint, name, F.lit("="), page.cast("string"))
    if most < 1 or not names:
        return F.array(start)
    pages = F.sequence(F.lit(1), F.lit(most))
    guesses = F.flatten(F.transform(pages, lambda p: F.array(*(guess(p, F.lit(n)) for n in names))))
    return F.concat(F.array(start), guesses)


def page_links(pages: DataFrame, url: str = "url", content: str = "html", where: Column | None = None) -> DataFrame:
    """(node, to) of the links of pages, as keys; ``where`` tests ``to`` as it stands in the page, made absolute.

    A link that a page has twice is one, and a page's link to itself is none. Pages without content or URL have none.
    """
    rows = pages.select(F.col(url).alias("__url"), F.explode(html.links(F.col(content))).alias("__link"))
    rows = rows.select(F.col("__url"), html.absolute(F.col("__url"), F.col("__link")).alias("to"))
    rows = rows if where is None else rows.filter(where)
    return rows.select(same_page(F.col("__url")).alias("node"), same_page(F.col("to")).alias("to")).filter("node != to").distinct()


def reached(seeds: DataFrame, links: DataFrame, most_steps: int | None = None) -> DataFrame:
    """(node, depth) of all nodes that links (node, to) lead to from seeds (node): depth is the fewest links on the way, 0 for a seed.

    Null nodes are dropped, seeds without links stay, cycles end. Steps follow until one finds nothing new, or ``most_steps`` are done. A
    step shuffles the links and the nodes met so far, not the pages; a node with many links is a hot key of the links' side only, which the
    engine splits, and targets that many nodes share are combined before the shuffle.
    """
    links = held(links.select("node", "to").filter("node IS NOT NULL AND to IS NOT NULL AND node != to"), "links")
    found = [held(seeds.select("node").filter("node IS NOT NULL").distinct().withColumn("depth", F.lit(0)), "frontier")]
    while not found[-1].isEmpty() and (most_steps is None or len(found) <= most_steps):
        met = reduce(DataFrame.unionByName, found).select("node")
        new = links.join(found[-1].select("node"), "node", "left_semi").select(F.col("to").alias("node")).distinct().join(met, "node", "left_anti")
        found.append(held(new.withColumn("depth", F.lit(len(found))), "frontier"))
    return reduce(DataFrame.unionByName, found)


def listed(pages: DataFrame, order: str, url: str = "url", content: str = "html", least_title: int = 4, where: Column | None = None) -> DataFrame:
    """(url, title, list_url) of the details that list pages point to, each once: as the first page by ``order`` and first place in it names it.

    Titles shorter than ``least_title`` characters name nothing; ``where`` tests ``to``, the absolute link.
    """
    rows = pages.select(F.col(order).alias("__order"), F.col(url).alias("__url"), F.posexplode(html.anchors(F.col(content))).alias("__pos", "__a"))
    rows = rows.select("__order", "__url", "__pos", F.col("__a.title").alias("title"), html.absolute(F.col("__url"), F.col("__a.href")).alias("to"))
    rows = rows.filter(F.length("title") >= least_title)
    rows = rows if where is None else rows.filter(where)
    first = F.min(F.struct("__order", "__pos", "__url", "title"))
    return rows.groupBy(same_page(F.col("to")).alias("url")).agg(first.alias("f")).select("url", F.col("f.title").alias("title"), F.col("f.__url").alias("list_url"))
