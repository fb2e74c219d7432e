"""Page elements: roles, interactivity, visibility, names, hashes, filters and text blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagelens.functions.columns import cell_of, fixed, rolling_hash, squeeze

# The role a tag has by itself, and an input by its type.
TAG_ROLES = {
    "a": "link", "button": "button", "select": "combobox", "textarea": "textbox", "h1": "heading", "h2": "heading", "h3": "heading", "h4": "heading", "h5": "heading", "h6": "heading",
    "nav": "navigation", "main": "main", "header": "banner", "footer": "contentinfo", "img": "img", "form": "form", "dialog": "dialog", "ul": "list", "ol": "list", "li": "listitem",
    "table": "table", "details": "group", "summary": "button",
}
INPUT_ROLES = {"checkbox": "checkbox", "radio": "radio", "search": "searchbox", "submit": "button", "button": "button", "reset": "button", "range": "slider"}
INTERACTIVE_TAGS = ("a", "button", "input", "select", "textarea", "summary", "details")
INTERACTIVE_ROLES = ("button", "link", "checkbox", "tab", "searchbox", "menuitem", "option", "combobox", "switch", "radio", "textbox", "slider", "code-editor")
NOT_EDITABLE_INPUTS = ("checkbox", "radio", "button", "submit", "reset", "hidden")


def _mapped(values: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), key)


def role_of(tag: Column, role: Column, kind: Column | None = None) -> Column:
    """The explicit role, else the tag's (an input's by its type), else null."""
    own = F.lower(F.trim(role))
    kind = F.lower(F.coalesce(kind if kind is not None else F.lit(None).cast("string"), F.lit("text")))
    by_tag = F.when(F.lower(tag) == "input", F.coalesce(_mapped(INPUT_ROLES, kind), F.lit("textbox"))).otherwise(_mapped(TAG_ROLES, F.lower(tag)))
    return F.coalesce(F.when(own != "", own), by_tag)


def interactivity(tag: Column, role: Column, kind: Column, enabled: Column) -> Column:
    """struct(interactive, clickable, editable, focusable, enabled); nulls count as no."""
    clickable = F.coalesce(F.lower(tag).isin(*INTERACTIVE_TAGS), F.lit(False)) | F.coalesce(role.isin(*INTERACTIVE_ROLES), F.lit(False))
    editable = F.coalesce((F.lower(tag) == "textarea") | ((F.lower(tag) == "input") & ~F.lower(F.coalesce(kind, F.lit(""))).isin(*NOT_EDITABLE_INPUTS)), F.lit(False))
    focusable = clickable | editable
    on = F.coalesce(enabled, F.lit(True))
    return F.struct((focusable & on).alias("interactive"), (clickable & on).alias("clickable"), (editable & on).alias("editable"), focusable.alias("focusable"), on.alias("enabled"))


def visibility(x: Column, y: Column, w: Column, h: Column, width: int, height: int) -> Column:
    """HIDDEN, OUTSIDE_VIEWPORT, VISIBLE or PARTIALLY_VISIBLE, the first that holds; a null box is HIDDEN."""
    return (
        F.when(x.isNull() | ((w == 0) & (h == 0)), "HIDDEN")
        .when(~((x + w > 0) & (x < width) & (y + h > 0) & (y < height)), "OUTSIDE_VIEWPORT")
        .when((x >= 0) & (y >= 0) & (x + w <= width) & (y + h <= height), "VISIBLE")
        .otherwise("PARTIALLY_VISIBLE")
    )


def occlusion(elements: DataFrame, width: int, height: int) -> DataFrame:
    """elements with `occlusion`, from the boxes that lie above a point in paint order.

    elements has page, ord (paint order) and x, y, w, h. The centre and the points at a
    quarter and three quarters are tested against later boxes of the page that are not
    inside the element. UNKNOWN where the element isn't on view.
    """
    e = elements.withColumn("vis", visibility(F.col("x"), F.col("y"), F.col("w"), F.col("h"), width, height))
    # each box is listed in the cells it covers, each point in its own: an equi-join on cells
    cell = 256
    cover = e.where("w > 0 and h > 0").select("page", F.col("ord").alias("o"), "x", "y", "w", "h")
    cover = cover.withColumn("cx", F.explode(F.sequence(cell_of(F.col("x"), cell), cell_of(F.col("x") + F.col("w"), cell)))).withColumn("cy", F.explode(F.sequence(cell_of(F.col("y"), cell), cell_of(F.col("y") + F.col("h"), cell))))
    seen = e.where(F.col("vis").isin("VISIBLE", "PARTIALLY_VISIBLE"))
    spots = F.array(*[F.struct(F.lit(i).alias("spot"), (F.col("x") + F.col("w") * f).alias("px"), (F.col("y") + F.col("h") * f).alias("py")) for i, f in enumerate((0.5, 0.25, 0.75))])
    points = seen.select("page", "ord", F.col("x").alias("ex"), F.col("y").alias("ey"), F.col("w").alias("ew"), F.col("h").alias("eh"), F.explode(spots).alias("s")).select("*", "s.*").drop("s")
    points = points.withColumn("cx", cell_of(F.col("px"), cell)).withColumn("cy", cell_of(F.col("py"), cell))
    inside = (F.col("x") >= F.col("ex")) & (F.col("y") >= F.col("ey")) & (F.col("x") + F.col("w") <= F.col("ex") + F.col("ew")) & (F.col("y") + F.col("h") <= F.col("ey") + F.col("eh"))
    above = (F.col("o") > F.col("ord")) & F.col("px").between(F.col("x"), F.col("x") + F.col("w")) & F.col("py").between(F.col("y"), F.col("y") + F.col("h")) & ~inside
    hit = points.join(cover, ["page", "cx", "cy"]).where(above).groupBy("page", "ord").agg(F.collect_set("spot").alias("hit"))
    covered = F.coalesce(F.col("hit"), F.array().cast("array<int>"))
    verdict = (
        F.when(~F.col("vis").isin("VISIBLE", "PARTIALLY_VISIBLE"), "UNKNOWN")
        .when(~F.array_contains(covered, 0), "NOT_OCCLUDED")
        .when(F.size(covered) < 3, "PARTIALLY_OCCLUDED")
        .otherwise("OCCLUDED")
    )
    return e.join(hit, ["page", "ord"], "left").withColumn("occlusion", verdict).drop("hit", "vis")


def accessible_name(*sources: Column) -> Column:
    """The first source that isn't blank, squeezed, at most 100 characters."""
    return F.coalesce(*[F.when(squeeze(s) != "", squeeze(s, 100)) for s in sources])


def signature(tag: Column, role: Column, kind: Column, name: Column, href: Column, parent: Column, path: Column) -> Column:
    """tag|role|type|name40|href|parent:...|path:..., empty parts for nulls."""
    e = lambda c: F.coalesce(c, F.lit(""))
    return F.concat(e(tag), F.lit("|"), e(role), F.lit("|"), e(kind), F.lit("|"), F.left(e(name), F.lit(40)), F.lit("|"), e(href), F.lit("|parent:"), e(parent), F.lit("|path:"), e(path))


def state_hash(elements: DataFrame, page: str, ord_: str, tag: Column, role: Column, text: Column) -> DataFrame:
    """(page, n, hash): the rolling hash of each page's elements in order, and their count."""
    part = F.concat_ws("|", F.coalesce(tag, F.lit("")), F.coalesce(role, F.lit("")), F.coalesce(text, F.lit("")))
    listed = elements.groupBy(page).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct(F.col(ord_).alias("o"), part.alias("p")))).alias("s"))
    return listed.select(page, "n", rolling_hash(F.array_join(F.transform("s", lambda x: x["p"]), ";")).alias("hash"))


def first_per_page(elements: DataFrame, page: str, ord_: str, most: int) -> DataFrame:
    """The first `most` rows of each page in order (a rank limit that stops early)."""
    return elements.withColumn("_rn", F.row_number().over(W.partitionBy(page).orderBy(ord_))).where(F.col("_rn") <= most).drop("_rn")


def element_filter(elements: DataFrame, text: str, role: str | None, fields: tuple[str, ...]) -> DataFrame:
    """Elements with the text (any case) in one of the fields, and the role if one is given."""
    hit = F.lit(False)
    for f in fields:
        hit = hit | F.coalesce(F.contains(F.lower(F.col(f)), F.lit(text.lower())), F.lit(False))
    out = elements.where(hit)
    return out if role is None else out.where(F.col("role") == role)


def text_blocks(elements: DataFrame) -> DataFrame:
    """(page, ord, target_id, text, n_words, confidence, x, y, w, h) of elements with text and box."""
    words = F.filter(F.split(F.trim("text"), r"\s+"), lambda x: x != "")
    n = F.size(words)
    rows = elements.where((F.trim("text") != "") & F.col("x").isNotNull())
    return rows.select("page", "ord", "target_id", "text", n.alias("n_words"), fixed(F.lit(0.85) + F.least(F.lit(0.14), n * 0.02), 2).alias("confidence"), "x", "y", "w", "h")
