"""Fields of a detail page, as rule ladders over the page tree.

A ladder takes the first rule that yields a value. Every selector offers only its
first match: when that fails the length test the next *selector* is tried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterline.functions.nodes import Page, Scope, attr
from rosterline.functions.text import (
    SPACE, WORD, clean_text, extract_emails, first_email, first_phone, let, py_strip,
)
from rosterline.operators.schema import Field, RecordSchema

BLANK = ""

# Words that mark a placeholder mailbox.
PLACEHOLDER_MAIL = ["example", "test", "noreply", "no-reply"]


def ladder(*rules: Column) -> Column:
    return F.coalesce(*rules, F.lit(BLANK))


def shorter(limit: int):
    return lambda t: (t != BLANK) & (F.length(t) < limit)


def between(low: int, high: int):
    return lambda t: (F.length(t) > low) & (F.length(t) < high)


def longer(limit: int):
    return lambda t: F.length(t) > limit


def given(t: Column) -> Column:
    return t != BLANK


def cut(limit: int):
    return lambda t: F.substring(t, 1, limit)


def class_has(*words: str) -> list[str]:
    return [f'[class*="{w}"]' for w in words]


def texts(page: Scope, selectors: list[str], accept, shape=lambda t: t) -> list[Column]:
    return [page.when_text(s, accept, shape) for s in selectors]


def non_empty(c: Column) -> Column:
    return F.nullif(c, F.lit(BLANK))


# --- detail-page resolvers -------------------------------------------------------------------


def resolve_name(page: Scope) -> Column:
    def meta(prop: str) -> Column:
        node = page.first_of(f'meta[property="{prop}"]', f'meta[name="{prop}"]')
        return let(attr(node, "content"), lambda v: F.when(between(3, 100)(v), clean_text(v)))

    return ladder(
        page.when_text("h1", between(3, 100)),
        meta("og:title"), meta("twitter:title"),
        page.when_text('[itemprop="name"]', between(3, 100)),
    )


def resolve_email(page: Scope) -> Column:
    href = attr(page.first('a[href^="mailto:"]'), "href")
    address = F.split_part(F.replace(href, F.lit("mailto:"), F.lit(BLANK)), F.lit("?"), F.lit(1))
    linked = let(address, lambda a: F.when(a.contains("@"), py_strip(a)))
    in_text = let(
        extract_emails(page.text),
        lambda found: F.coalesce(
            F.get(F.filter(found, lambda e: ~F.lower(e).rlike("|".join(PLACEHOLDER_MAIL))), F.lit(0)),
            F.get(found, F.lit(0)),
        ),
    )
    return ladder(linked, in_text)


def resolve_phone(page: Scope) -> Column:
    linked = let(
        page.first('a[href^="tel:"]'),
        lambda n: F.when(n.isNotNull(), py_strip(F.replace(attr(n, "href"), F.lit("tel:"), F.lit(BLANK)))),
    )
    return ladder(linked, first_phone(page.text))


def resolve_title(page: Scope, name: Column) -> Column:
    def not_the_name(t: Column) -> Column:
        return shorter(200)(t) & (F.lower(t) != F.lower(name))

    return ladder(
        page.when_text('[itemprop="jobTitle"]', given),
        *texts(page, [*class_has("title", "position", "role"), ".job-title"], not_the_name),
    )


def _opening_paragraphs(page: Scope, container: Column, limit: int) -> Column:
    def collect(box: Column) -> Column:
        firsts = F.slice(page.within(box).select("p"), 1, 3)
        kept = F.filter(F.transform(firsts, page.clean_text_of), longer(30))
        return F.when(box.isNotNull(), non_empty(F.substring(F.array_join(kept, " "), 1, limit)))

    return let(container, collect)


def resolve_bio(page: Scope, limit: int = 1000) -> Column:
    selectors = ['[itemprop="description"]', *class_has("bio", "about", "description"), "#biography", "#about"]
    return ladder(
        *texts(page, selectors, longer(50), cut(limit)),
        _opening_paragraphs(page, page.first_of("main", "body"), limit),
    )


def resolve_page_url(page: Scope, current_url: Column) -> Column:
    return F.coalesce(
        non_empty(attr(page.first('link[rel="canonical"]'), "href")),
        non_empty(attr(page.first('meta[property="og:url"]'), "content")),
        current_url,
    )


def resolve_org(page: Scope) -> Column:
    return ladder(
        page.when_text('[itemprop="affiliation"]', given),
        *texts(page, [*class_has("department", "organization", "affiliation"), ".dept", ".org"], shorter(200)),
    )


def resolve_location(page: Scope) -> Column:
    return ladder(
        page.when_text('[itemprop="address"]', given),
        *texts(page, [*class_has("location", "address"), ".office", ".location"], shorter(300)),
    )


def resolve_all_fields(dom: DataFrame, *keys: str, url: str = "url") -> DataFrame:
    """Keys plus the eight fields of a detail page; one narrow stage."""
    page = Page()
    named = dom.withColumn("name", resolve_name(page))
    return named.select(
        *keys, "name",
        resolve_email(page).alias("email"),
        resolve_phone(page).alias("phone"),
        resolve_title(page, F.col("name")).alias("title"),
        resolve_bio(page).alias("bio"),
        resolve_page_url(page, F.col(url)).alias("page_url"),
        resolve_org(page).alias("org"),
        resolve_location(page).alias("location"),
    )


# --- generic, schema-driven extraction -------------------------------------------------------


def generic_email(page: Scope) -> Column:
    return first_email(page.text)


def generic_phone(page: Scope) -> Column:
    return first_phone(page.text)


def generic_name(page: Scope) -> Column:
    return ladder(
        page.when_text("h1", shorter(100)),
        let(attr(page.first('meta[property="og:title"]'), "content"), lambda v: F.when(given(v), clean_text(v))),
        *texts(page, ['[class*="name"]', '[itemprop="name"]', '[class*="title"]', "h2", "h3"], between(5, 100)),
    )


def generic_title(page: Scope) -> Column:
    label = rf"(?:title|position|role){SPACE}*:"
    labelled = rf"(?i)(?<!{WORD})" + label
    # A node can carry the label only if the page text does, so most pages skip the node scan.
    scan = F.when(
        page.text.rlike("(?i)" + label),
        F.get(F.filter(F.transform(page.nodes, page.text_of), lambda t: t.rlike(labelled)), F.lit(0)),
    )
    return ladder(
        *texts(page, [*class_has("title", "position", "role"), '[itemprop="jobTitle"]', ".job-title", ".position"],
               shorter(200)),
        let(scan, lambda t: F.when(t.isNotNull(), clean_text(F.regexp_extract(t, r"(?s)^[^:]*:(.*)$", 1)))),
    )


def generic_bio(page: Scope, limit: int = 1000) -> Column:
    selectors = [*class_has("bio", "about", "description"), '[itemprop="description"]', ".biography", ".about-text"]
    return ladder(
        *texts(page, selectors, longer(50), cut(limit)),
        _opening_paragraphs(page, page.first_of("main", "#content", "body"), limit),
    )


def generic_org(page: Scope) -> Column:
    selectors = [*class_has("department", "organization", "affiliation"), '[itemprop="affiliation"]', ".department",
                 ".org"]
    return ladder(*texts(page, selectors, shorter(200)))


def generic_location(page: Scope) -> Column:
    selectors = [*class_has("location", "address"), '[itemprop="address"]', ".location", ".address"]
    return ladder(*texts(page, selectors, shorter(300)))


def value_near_label(page: Scope, node: Column, label: Column) -> Column:
    """Next sibling's text, else the parent's next sibling's, else what follows a colon; null if none."""

    def usable(text: Column) -> Column:
        return let(text, lambda t: F.when((t != BLANK) & (F.lower(t) != F.lower(label)), clean_text(t)))

    own = py_strip(page.text_of(node))
    return F.coalesce(
        usable(page.next_text_of(node)),
        usable(page.next_text_of(page.parent_of(node))),
        F.when(own.contains(":"), clean_text(F.regexp_extract(own, r"(?s)^[^:]*:(.*)$", 1))),
    )


def _quote(label: str) -> str:
    return "".join(c if c.isalnum() or c.isspace() else "\\" + c for c in label)


def extract_by_label(page: Scope, labels: list[str], faithful: bool = False) -> Column:
    """Value next to the first node that carries a label as a whole word.

    ``faithful`` scans outermost first, in document order, so a label anywhere makes
    the page itself the first hit. The default takes the innermost carriers first.
    """

    def by_one(label: str) -> Column:
        edge_before = rf"(?<!{WORD})" if label[:1].isalnum() else rf"(?<={WORD})"
        edge_after = rf"(?!{WORD})" if label[-1:].isalnum() else rf"(?={WORD})"
        pattern = "(?i)(?u)" + edge_before + _quote(label) + edge_after

        def values(carriers: Column) -> Column:
            # In document order a carrier holds another one exactly when it holds the next.
            inner = F.filter(
                carriers, lambda n, i: F.coalesce(F.get(carriers, i + 1)["id"] > n["last"], F.lit(True))
            )
            ordered = carriers if faithful else F.concat(inner, F.reverse(carriers))
            found = F.transform(ordered, lambda n: value_near_label(page, n, F.lit(label)))
            return F.get(F.filter(found, lambda v: v != BLANK), F.lit(0))

        carriers = F.filter(page.nodes, lambda n: page.text_of(n).rlike(pattern))
        # Neighbouring nodes' words run together in the page text, so only the bare label can rule a page out.
        return F.when(page.text.rlike("(?i)(?u)" + _quote(label)), let(carriers, values))

    return F.coalesce(*[by_one(label) for label in labels]) if labels else F.lit(None).cast("string")


def extract_field(page: Scope, f: Field, extra_labels: tuple[str, ...] = (), faithful: bool = False) -> Column:
    """Label first, then pattern, then the ladder its name calls for."""
    by_name = {
        ("name",): generic_name,
        ("title", "position", "role"): generic_title,
        ("bio", "biography", "description"): generic_bio,
        ("org", "organization", "company", "department"): generic_org,
        ("location", "address"): generic_location,
    }
    if f.base_type == "email":
        rule = generic_email(page)
    elif "phone" in f.name.lower():
        rule = generic_phone(page)
    else:
        build = next((b for names, b in by_name.items() if f.name in names), None)
        rule = build(page) if build else F.lit(BLANK)
    return F.coalesce(extract_by_label(page, [f.name, *f.synonyms, *extra_labels], faithful), rule)


def extract_by_schema(
    dom: DataFrame, schema: RecordSchema, *keys: str, url: str = "url",
    synonyms: dict[str, list[str]] | None = None, faithful: bool = False,
) -> DataFrame:
    """``page_url`` and one column per schema field.

    A schema field named ``page_url`` keeps the page's URL, unless ``faithful`` lets
    the extracted value overwrite it. ``synonyms`` adds site-specific labels.
    """
    page = Page()
    columns = {"page_url": F.col(url)}
    for f in schema.fields:
        if f.name == "page_url" and not faithful:
            continue
        columns[f.name] = extract_field(page, f, tuple((synonyms or {}).get(f.name, ())), faithful)
    return dom.select(*keys, *[c.alias(name) for name, c in columns.items()])
