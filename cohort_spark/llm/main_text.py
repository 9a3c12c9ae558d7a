"""The main text of web pages by the distribution of text over blocks of lines.

Markup is stripped to lines, one per block (``markup``). Elements that the page itself sets aside
(navigation, footers, adverts, forms, comments, ...) leave blank lines, and if the page says where its
article is, so does all outside of it. For each line the text of a sliding window of ``WINDOW`` lines is
added up. The sum surges where text begins and dives to nothing where only blank lines follow; the
lines between are kept if the sum reaches a height on the way that short notes do not.

In an article's element every line counts and none is blank, so it is kept whole. Elsewhere only
characters outside links count, and elements that hold blocks leave blank lines around them.

Each page is worked on by itself, so there is no shuffle; a task holds one batch of pages.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohort_spark.llm import bytes as B
from cohort_spark.llm.markup import CONTAINERS, HEADINGS, Page, read

WINDOW = 3
# A stretch of lines is text if a window reaches this, or half of the highest window of the page.
HEIGHT = 80
# Blank lines for the start or the end of an element that holds blocks.
GAP = 2

# Headings of reader comments, without digits and signs.
COMMENTS = re.compile(
    r"(?:(?:reader|user)s?\s)?comments?|responses?|replies|discussion|leave a (?:reply|comment)|post a comment|(?:add|write) a comment"
    r"|kommentare?|kommentar schreiben|commentaires?|laisser un commentaire|comentarios?|deja un comentario",
    re.I,
)
_NOT_WORDS = re.compile(r"[^\w\s]|\d")


def _set_aside(page: Page) -> tuple[list[bool], list[int]]:
    """Whether each element is beside the article, and the elements that are articles."""
    names, parents, marks = page.names, page.parents, list(page.marks)
    surely = [False] * len(names)
    maybe = [False] * len(names)
    in_article = [False] * len(names)
    for i in range(1, len(names)):
        up = parents[i]
        in_article[i] = in_article[up] or names[i] in ("article", "main") or marks[i] < 0
        surely[i] = surely[up] or marks[i] == 2 or (names[i] == "header" and not in_article[i])
        maybe[i] = maybe[up] or marks[i] == 1
    own = [i for i in range(1, len(names)) if (names[i] in ("article", "main") or marks[i] < 0) and not surely[i] and marks[i] != 1]
    clear = [i for i in own if not maybe[i]]
    if not clear and own:
        # What holds the only article is not beside it, whatever it is called.
        clear = [max(own, key=lambda i: sum(x.plain for x in page.lines if page.inside(x.node, i)))]
    freed = clear or [i for i in range(1, len(names)) if names[i] == "h1" and not surely[i]]
    for i in freed:
        while i > 0:
            marks[i] = min(marks[i], 0)
            i = parents[i]
    aside = [False] * len(names)
    for i in range(1, len(names)):
        aside[i] = aside[parents[i]] or surely[i] or marks[i] == 1
    clear = [i for i in clear if not aside[i]]
    articles = [i for i in clear if names[i] == "article"]
    mains = [i for i in clear if names[i] != "article"]
    within = [i for i in articles if any(page.inside(i, m) for m in mains)]
    chosen = within or articles or mains
    outer = [i for i in chosen if not any(i != j and page.inside(i, j) for j in chosen)]
    # The heading of a main part stands before its article.
    heads = [i for i in range(1, len(names)) if names[i] == "h1" and not aside[i] and any(page.inside(i, m) for m in mains)]
    return aside, sorted(outer + [h for h in heads if not any(page.inside(h, i) for i in outer)])


def stretches(weights: Sequence[int], window: int = WINDOW) -> list[tuple[int, int, int]]:
    """(surge, dive, highest window) of each stretch of lines between windows without text.

    ``dive`` is exclusive; a stretch begins and ends with a line that has text.
    """
    out: list[tuple[int, int, int]] = []
    first, last, high, total = -1, -1, 0, 0
    for i, weight in enumerate(weights):
        total += weight - (weights[i - window] if i >= window else 0)
        if total == 0 and first >= 0:
            out.append((first, last + 1, high))
            first, high = -1, 0
        if weight:
            first = i if first < 0 else first
            last = i
        if first >= 0:
            high = max(high, total)
    if first >= 0:
        out.append((first, last + 1, high))
    return out


def main_text(source: str | None, *, window: int = WINDOW, height: int = HEIGHT) -> str:
    """The article of one page: its blocks, one per line."""
    if not source:
        return ""
    page = read(source)
    aside, articles = _set_aside(page)
    place = [0] * len(page.names)
    for k, a in enumerate(articles):
        # A heading before an article is a part of it.
        place[a] = next((b for b in articles[k:] if page.names[b] != "h1"), a)
    for i in range(1, len(place)):
        place[i] = place[i] or place[page.parents[i]]
    holder = [0] * len(page.names)
    for i in range(1, len(holder)):
        holder[i] = i if page.names[i] in CONTAINERS else holder[page.parents[i]]
    depth = [0] * len(page.names)
    for i in range(1, len(depth)):
        depth[i] = depth[page.parents[i]] + (page.names[i] in CONTAINERS)
    lines: list[tuple[int, int]] = []  # weight, number of the line or -1
    before, cut = -1, []
    for number, line in enumerate(page.lines):
        node = line.node
        if aside[node] or (articles and not place[node]) or any(page.inside(node, c) for c in cut):
            lines += [(0, -1)] * window
            continue
        if page.names[node] in HEADINGS and COMMENTS.fullmatch(_NOT_WORDS.sub("", line.text).strip()):
            cut = [*cut, page.parents[node]]
            lines += [(0, -1)] * window
            continue
        if articles:
            blanks, weight = 0 if before < 0 or place[before] == place[node] else window, len(line.text)
        else:
            # Elements that end and begin between two lines.
            blanks, weight = 0, line.plain
            if before >= 0 and holder[before] != holder[node]:
                up, down, steps = holder[before], holder[node], 0
                while up != down and steps < window:
                    if depth[up] >= depth[down]:
                        up = holder[page.parents[up]] if up else 0
                    else:
                        down = holder[page.parents[down]]
                    steps += 1
                blanks = GAP * steps
        lines += [(0, -1)] * blanks
        lines.append((weight, number))
        before = node
    # A removed element inside an article is no end of it.
    if articles:
        lines = _bridged(lines, [place[page.lines[n].node] if n >= 0 else 0 for _, n in lines])
    found = stretches([w for w, _ in lines], window)
    if not found:
        return ""
    least = min(height, max(h for _, _, h in found) / 2)
    good = [(a, b) for a, b, h in found if h >= least]
    kept = [n for a, b in good for _, n in lines[a:b] if n >= 0]
    if not articles:
        # Short lines between kept ones, in sister elements of theirs.
        sisters = {page.parents[holder[page.lines[n].node]] for n in kept}
        between = [n for w, n in lines[good[0][0] : good[-1][1]] if n >= 0 and w and page.parents[holder[page.lines[n].node]] in sisters]
        kept = sorted({*kept, *between})
    return "\n".join(page.lines[n].text for n in kept)


def _bridged(lines: list[tuple[int, int]], places: list[int]) -> list[tuple[int, int]]:
    """The lines without blank ones between two lines of one article."""
    out: list[tuple[int, int]] = []
    waiting: list[tuple[int, int]] = []
    last = 0
    for line, where in zip(lines, places, strict=True):
        if line[1] < 0:
            waiting.append(line)
            continue
        out += [] if where == last else waiting
        waiting = []
        out.append(line)
        last = where
    return out + waiting


def extract(
    pages: DataFrame, *, html: str = "html", keep: Sequence[str] = ("page_id", "url"), window: int = WINDOW, height: int = HEIGHT
) -> DataFrame:
    """The ``keep`` columns and ``text``, the main text of each page; never null.

    Character references are decoded, white space within a block becomes one space, blocks are joined
    by a line feed. Cells of a table row are one block; a line break is white space.

    Defined cases: null, empty or text-free pages have an empty text; a page without markup is its
    text; repeated rows and null identifiers stay as they are; pages with several articles keep each
    that is long enough; an empty table gives an empty one; columns beside ``keep`` are not read, and
    ``keep`` must not name one ``text``.
    """
    if "text" in keep:
        raise ValueError("the result has a text column of its own")
    names = [f"c{i}" for i in range(len(keep))]
    kinds = [T.StructField(n, pages.schema[c].dataType) for n, c in zip(names, keep, strict=True)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in B.pieces(batch, "html"):
                texts = [main_text(x, window=window, height=height) for x in piece.column("html").to_pylist()]
                columns = [piece.column(n) for n in names]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string())], names=[*names, "text"])

    rows = pages.select(*[F.col(f"`{c}`").alias(n) for n, c in zip(names, keep, strict=True)], F.col(f"`{html}`").alias("html"))
    return rows.mapInArrow(work, T.StructType([*kinds, T.StructField("text", T.StringType())])).toDF(*keep, "text")
