"""HTML extraction (operator 7): equivalence-class template deduction.

A token is an opening tag or a block of text, each with the path of containers around it: the same words in another
container are another token. Over the pages of a host every token has an occurrence vector (how often it stands on each
page). Tokens with the same vector form an equivalence class; a class is valid if it has enough pages and two tokens.
Its tokens' mean places give its order, and it is nested: the class of the tokens that every page has once is the root,
and a further class lies in a slot between two tokens of a class with as many pages or more (its tokens are dealt to
several slots where it spans them). So the valid classes of a host are a tree, its template.

A page is matched with the tree from the root down: a class's tokens match where they keep its order inside their slot.
Text blocks that match are the template's own, inside article elements too; what remains in the slots is the page's.
The container that holds most of the host's remaining text is the article's. Article and main elements are hints: they
rank the containers, and they choose on pages without the host's container. Names of classes and ids are votes, which
the host has to confirm.

Occurrence vectors are never gathered: a vector is represented by the sum, over its pages, of a hash of
page and count, which adds up in any order, inside tasks first. So a host with a third of all pages
costs each task one row a token. What a host's template takes is bounded by its pages' size, not by their number.
"""

from __future__ import annotations

import bisect
import html
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curatrix.llm.common import BROADCAST_BYTES, settled, short_batches

_TAG = re.compile(r"<!--|<!|<\?|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*+)>")
_ATTRIBUTE = re.compile(r"(class|id|role|aria-hidden|style|hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)|(?=[\s/>]|$))", re.I)

#: Elements (fixed values): those whose text is no text, those that are never part of an article, those that end a block.
_RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes"}
_NEVER = {"nav", "footer", "aside", "form", "button", "select", "dialog", "menu", "template", "svg", "math", "head", "canvas", "audio", "video", "object", "datalist", "label"}
_CONTAINERS = _NEVER | {"article", "main", "div", "section", "header", "ul", "ol", "dl", "table", "figure", "body", "details", "blockquote", "fieldset", "center", "li"}
_BLOCKS = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol p pre section summary table tbody thead tfoot tr ul caption option".split())
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = {"span", "a", "b", "i", "em", "strong", "small", "sup", "sub", "ins", "del", "u", "mark", "cite", "abbr", "time", "font", "code", "td", "th"}
_GAPS = {"br", "td", "th", "img", "input"}
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar", "form"}
_NAMES = re.compile(
    r"(?:ad|ads|adv|adbox|adslot|adunit|advert\w*|adsby\w*|sponsor\w*|promo\w*|banner\w*|cookie\w*|consent\w*|gdpr|notice\w*|notification\w*|alert\w*|popup\w*|modal\w*|overlay|newsletter\w*|subscri\w*|"
    r"sidebar\w*|side|aside|nav|navbar|navigation|navi|menu\w*|topbar|breadcrumb\w*|foot|footer\w*|head|header|masthead|comment|comments|commentlist|reply|replies|respond|discussion|disqus\w*|reader|readers|"
    r"share|sharing|social\w*|related\w*|recommend\w*|widget\w*|toolbar|pagination|pager|login|signin|signup|register|search\w*|form|copyright|legal|skip|outbrain|taboola|paywall)"
)
_SPLIT = re.compile(r"[\s_-]+|(?<=[a-z])(?=[A-Z])")
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}


_DIGITS = re.compile(r"\d+")


def _marked(name: str, attributes: str) -> tuple[bool, str, str]:
    """(whether an element is hidden or has a role beside the article, which names vote against it: "", "id" or "class", its signature).

    A heading's id is the slug of its words and an inline element's an anchor: they don't vote.
    """
    if not attributes or "=" not in attributes and "hidden" not in attributes:
        return False, "", name
    marked, vote, signature = False, "", name
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), (m[2] or "").strip("\"'")
        if key in ("class", "id"):
            signature += (".#"[key == "id"]) + _DIGITS.sub("0", ".".join(value.split()))
            if vote != "class" and not (key == "id" and (name in _HEADINGS or name in _INLINE)) and any(_NAMES.fullmatch(part.lower()) for part in _SPLIT.split(value) if part):
                vote = key
        elif key == "role":
            marked = marked or value.lower() in _ROLES
        elif key == "style":
            marked = marked or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I) is not None
        else:
            marked = marked or value.lower() != "false"
    return marked, vote, signature


def token_hash(token: str) -> int:
    value = xxhash.xxh64_intdigest(token, 11)
    return value - (1 << 64) if value >= 1 << 63 else value


#: The token of the page itself as a container.
ROOT = token_hash("")


def _within(parent: int, signature: str, name: str, top: tuple) -> tuple[int, int, int]:
    """(token, outermost article's token or 0, outermost main's) of an element in an open container."""
    token = token_hash(f"{parent}>{signature}")
    return token, top[9] or (token if name == "article" else 0), top[10] or (token if name == "main" else 0)


class Page:
    """One pass over a page: its opening tags, its containers and its blocks of text in order.

    A tag's token is a hash of its parent's token and its signature, so it stands for the whole path, however deep. tags: (token,
    place, token of the outermost article or else main element around it or 0); containers (parent, token, that element's token), parents
    first, 0 is the page; blocks: (text, container, in an article, in main, excluded, place); places count tags and blocks, in
    page order. chains: (signature, chain around it or -1) of the elements around a place whose names vote against them;
    votes: characters inside each such signature; hidden: characters of the articles that only names exclude, by
    chain. refuted holds the signatures whose votes don't count; without it (no template) ids inside an article don't
    count either.
    """

    def __init__(self, source: str, refuted: frozenset | set | None = None):
        self.tags: list[tuple[int, int, int]] = []
        self.containers: list[tuple[int, int, int]] = [(-1, ROOT, 0)]
        self.blocks: list[tuple[str, int, bool, bool, bool, int]] = []
        self.chains: list[tuple[str, int]] = []
        self.votes: dict[str, int] = {}
        self.hidden: dict[int, int] = {}
        numbers: dict[tuple[str, int], int] = {}
        inside_chain: list[int] = []
        # An open container: name, container, article depth, main depth, excluded, whether only headings count, excluded by more than names, chain of votes, chain around an article,
        # tokens of the outermost article and main element.
        stack: list[tuple] = [("", 0, False, False, False, False, False, -1, -1, 0, 0)]
        parts: list[str] = []
        heading = False
        at, n = 0, len(source)
        lower = None
        last = source.rfind(">") + 1  # no tag ends after it
        unclosed: dict[int, bool] = {}

        def flush() -> None:
            if parts:
                text = " ".join(html.unescape("".join(parts)).split())
                parts.clear()
                if text:
                    top = stack[-1]
                    self.blocks.append((text, top[1], top[2], top[3], top[4] or (top[5] and not heading), len(self.tags) + len(self.blocks)))
                    if top[7] >= 0 and not top[6]:
                        inside_chain[top[7]] += len(text)
                        if top[8] == top[7]:
                            self.hidden[top[8]] = self.hidden.get(top[8], 0) + len(text)

        while at < n:
            m = _TAG.search(source, at, last)
            if m is None:
                parts.append(source[at:])
                break
            if m.start() > at and not (stack[-1][4] and stack[-1][0] in _INLINE):
                parts.append(source[at : m.start()])
            at = m.end()
            name = m[2] or m[5]
            if name is None:  # a comment, declaration or instruction
                end = source.find("-->", at) if m[0] == "<!--" else source.find(">", at)
                at = n if end < 0 else end + (3 if m[0] == "<!--" else 1)
                continue
            name, closing = name.lower(), bool(m[1] or m[4])
            if name in _BLOCKS or name in _NEVER:
                flush()
                if stack[-1][0] == "p":
                    stack.pop()
            elif name in _GAPS:
                parts.append(" ")
            if name in _HEADINGS:
                heading = not closing
            if closing:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == name:
                        if name not in _INLINE:
                            flush()
                        del stack[k:]
                        break
                continue
            attributes = m[3] if m[3] is not None else m[6] or ""
            marked, vote, signature = _marked(name, attributes)
            top = stack[-1]
            if vote and (name == "body" or (vote == "id" and refuted is None and (top[2] or top[3])) or (refuted and token_hash(signature) in refuted)):
                vote = ""
            if vote:
                self.votes.setdefault(signature, 0)
            token, article, main = _within(self.containers[top[1]][1], signature, name, top)
            self.tags.append((token, len(self.tags) + len(self.blocks), article or main))
            if name in _RAW:
                if lower is None:
                    lower = source.lower() if source.isascii() else "".join(c.lower() if c < "\x80" else c for c in source)
                end = lower.find(f"</{name}", at)
                close = source.find(">", end) if end >= 0 else -1
                at = n if close < 0 else close + 1
                continue
            if name in _VOID or attributes.endswith("/"):
                continue
            if marked or vote or name in _CONTAINERS:
                if name not in _INLINE:
                    flush()
                if top[4] and name in ("article", "main") and not marked and not vote and self._unclosed(source, at, stack, unclosed):
                    while stack[-1][4]:  # the element that hides this article is never closed: it ends here
                        stack.pop()
                    top = stack[-1]
                if name in ("body", "main", "article") and stack[-1][0] == "head":
                    stack.pop()
                    top = stack[-1]
                token, article, main = _within(self.containers[top[1]][1], signature, name, top)  # top may be another one now
                self.containers.append((top[1], token, article or main))
                inside = top[2] or top[3]
                header = name == "header" and not marked and not vote
                hard = top[6] or (marked and name not in ("body", "main")) or name in _NEVER or (header and not inside)
                votes = top[7]
                if vote and name != "main":
                    votes = numbers.setdefault((signature, top[7]), len(self.chains))
                    if votes == len(self.chains):
                        self.chains.append((signature, top[7]))
                        inside_chain.append(0)
                excluded = hard or votes >= 0
                around = votes if name in ("article", "main") and not hard and not inside else top[8]
                stack.append((name, len(self.containers) - 1, top[2] or (name == "article" and not excluded), top[3] or (name == "main" and not excluded), excluded, top[5] or header, hard, votes, around, article, main))
        flush()
        for k in range(len(self.chains) - 1, -1, -1):  # a chain's characters are those of the chains around it too
            signature, outer = self.chains[k]
            self.votes[signature] += inside_chain[k]
            if outer >= 0:
                inside_chain[outer] += inside_chain[k]

    @staticmethod
    def _unclosed(source: str, at: int, stack, known: dict[int, bool]) -> bool:
        """Whether the outermost element that hides this place has no closing tag after it."""
        hiding = next(x for x in stack if x[4])
        if id(hiding) not in known:
            opened = sum(1 for _ in re.finditer(rf"<{hiding[0]}[\s>]", source[at:], re.I))
            closed = sum(1 for _ in re.finditer(rf"</{hiding[0]}\s*>", source[at:], re.I))
            known[id(hiding)] = closed <= opened
        return known[id(hiding)]

    def chain(self, k: int) -> Iterator[str]:
        """The signatures of a chain, from the inside out."""
        while k >= 0:
            signature, k = self.chains[k]
            yield signature

    def text(self, main: int | None, template) -> str:
        """The article: blocks of the host's main container that are not the template's; on pages without it, of article elements, main, or all.

        Should the template's blocks be half of an article element or more, or all there is, the page is a copy of others,
        and its text is whole.
        """
        kept = [b for b in self.blocks if not b[4]]
        own = self._template(kept, template)
        within: list[bool] = []  # of each container, whether it is the main one or lies in it
        for parent, token, _ in self.containers:
            within.append(token == main or (parent >= 0 and within[parent]))
        inside = [k for k, b in enumerate(kept) if within[b[1]]]
        if not any(kept[k][2] for k in inside) and any(b[2] for b in kept):
            inside = []  # the page's article lies elsewhere
        for places in (inside, [k for k, b in enumerate(kept) if b[2]], [k for k, b in enumerate(kept) if b[3]]):
            if places:
                rest = [k for k in places if k not in own]
                article = [k for k in places if kept[k][2] or kept[k][3]]
                dropped = sum(len(kept[k][0]) for k in article if k in own)
                copy = not rest or 2 * dropped >= sum(len(kept[k][0]) for k in article) > 0
                return "\n".join(kept[k][0] for k in (places if copy else rest))
        return "\n".join(b[0] for k, b in enumerate(kept) if k not in own)

    def _template(self, kept: list, template) -> set[int]:
        """Numbers of the kept blocks that match the template: its classes (parent, slot, tokens), parents first."""
        if not template:
            return set()
        at: dict[int, list[int]] = {}
        for token, place, _ in self.tags:
            at.setdefault(token, []).append(place)
        for b in kept:
            at.setdefault(text_token(self.containers[b[1]][1], b[0]), []).append(b[5])
        own: set[int] = set()
        found: list[list[tuple[int, int]]] = []  # of each class: (number of the token, its first place) where it matches
        for parent, slot, tokens in template:
            low, high = -1, len(self.tags) + len(self.blocks)
            for k, place in found[parent] if parent >= 0 else ():
                if k < slot:
                    low = place
                else:
                    high = place
                    break
            here = [(k, inside) for k, t in enumerate(tokens) if t in at and (inside := [p for p in at[t] if low < p < high])]
            chain = _rising([places[0] for _, places in here])
            found.append([(here[k][0], here[k][1][0]) for k in chain])
            own.update(p for k in chain for p in here[k][1])
        return {k for k, b in enumerate(kept) if b[5] in own}


def _rising(values: list[int]) -> list[int]:
    """Numbers of a longest rising run of the values."""
    ends: list[int] = []
    tails: list[int] = []
    before: list[int] = [0] * len(values)
    for k, v in enumerate(values):
        j = bisect.bisect_left(ends, v)
        ends[j : j + 1], tails[j : j + 1] = [v], [k]
        before[k] = tails[j - 1] if j else -1
    out, k = [], tails[-1] if tails else -1
    while k >= 0:
        out.append(k)
        k = before[k]
    return out[::-1]


def nested(tokens: list[tuple]) -> list[tuple[int, int, list[int]]]:
    """The classes of a host as a tree (parent, slot, tokens), parents first; -1 is no parent, slot k lies before a parent's token k.

    tokens: (class, pages, token, mean place) of valid classes. Classes are taken by falling page counts, so that what stands
    on more pages is further out. From the first (the root) down, a class goes into the slot where its tokens lie; tokens in
    different slots part there.
    """
    classes: dict = {}
    for cls, pages, token, place in tokens:
        classes.setdefault((pages, cls), []).append((place, token))
    made: list[tuple[int, int, list[int]]] = []
    places: list[list[float]] = []
    below: dict[tuple[int, int], list[int]] = {}  # (class, slot) -> the classes in it

    def dealt(members: list[tuple[float, int]], parent: int) -> list[tuple]:
        """The members by the parent's slots, the last slot first."""
        parts: dict[int, list] = {}
        for place, token in members:
            parts.setdefault(bisect.bisect_left(places[parent], place), []).append((place, token))
        return [(part, parent, k) for k, part in sorted(parts.items(), reverse=True)]

    def put(todo: list[tuple]) -> None:
        while todo:
            members, parent, slot = todo.pop()
            over = [c for c in below.get((parent, slot), ()) if places[c][0] < members[0][0] and members[-1][0] < places[c][-1]]
            if over:  # inside the first class there that reaches over all of them
                todo.extend(dealt(members, over[0]))
                continue
            below.setdefault((parent, slot), []).append(len(made))
            made.append((parent, slot, [t for _, t in members]))
            places.append([p for p, _ in members])

    for _, members in sorted(classes.items(), key=lambda x: (-x[0][0], -len(x[1]), x[0][1])):
        members.sort()
        put(dealt(members, 0) if made else [(members, -1, 0)])
    return made


def read_page(source: str, refuted: frozenset | set | None = None) -> Page:
    """The page; if its text lies in an article that only names exclude, those names don't count."""
    page = Page(source, refuted)
    if page.hidden:
        votes, size = max(page.hidden.items(), key=lambda x: x[1])
        if size > sum(len(b[0]) for b in page.blocks if not b[4]):
            again = Page(source, (refuted or set()) | {token_hash(v) for v in page.chain(votes)})
            return again
    return page


def text_token(container: int, text: str) -> int:
    return token_hash(f"{container}\n{text}")


def host_of(url: Column) -> Column:
    """The host of a URL, lower-cased; null and odd URLs have the empty host."""
    return F.lower(F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


#: kind: 0 the page, 1 a tag, 2 a text block, 3 a text block in an article or main element, 4 a signature whose names vote against it.
#: container: a tag's own token, a block's container's; element: the article or main element around it; name: of kind 4 alone.
_FACTS = "host string, token long, container long, element long, name string, sig decimal(20,0), pages long, kind long, most long, place double, chars long"


def _facts(batches):
    """Per host and token of a task: sum of vector hashes, pages, kind, highest count, sum of places, characters directly inside."""
    known: dict[tuple[str, int], list] = {}

    def rows():
        from decimal import Decimal

        keys, values = list(known), list(known.values())
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.decimal128(20, 0), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64()]
        columns = [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int64())]
        columns += [pa.array([Decimal(v[i]) if i == 3 else v[i] for v in values], kind) for i, kind in enumerate(kinds)]
        out = pa.RecordBatch.from_arrays(columns, ["host", "token", "container", "element", "name", "sig", "pages", "kind", "most", "place", "chars"])
        known.clear()
        return out

    for batch in batches:
        for host, page, source in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            parsed = read_page(source or "", frozenset())
            counts: dict[int, list] = {}
            for token, place, element in parsed.tags:
                counts.setdefault(token, [token, element, None, 0, place, 0, 1])[3] += 1
            total = max(1, len(parsed.tags) + len(parsed.blocks))
            whole = 0
            for text, container, article, main, excluded, place in parsed.blocks:
                whole += len(text)
                if excluded:
                    continue
                _, token, element = parsed.containers[container]
                if (own := counts.get(token)) is not None:
                    own[5] += len(text)
                own = counts.setdefault(text_token(token, text), [token, element, None, 0, place, 0, 3 if article or main else 2])
                own[3] += 1
                own[5] += len(text)
            for signature, chars in parsed.votes.items():
                counts[token_hash("vote " + signature)] = [0, 0, signature, 1, 0, chars, 4]
            # The page itself is a token too: it stands once on every page and so leads the root class.
            counts[0] = [0, 0, None, 1, -1, whole, 0]
            for token, (container, element, name, n, place, chars, kind) in counts.items():
                sign = xxhash.xxh64_intdigest(f"{page}/{n}", 12) >> 4
                row = known.get((host, token))
                if row is None:
                    known[host, token] = [container, element, name, sign, 1, kind, n, place / total, chars]
                else:
                    row[3] = (row[3] + sign) % 10**18
                    row[4] += 1
                    row[6] = max(row[6], n)
                    row[7] += place / total
                    row[8] += chars
            if len(known) > 150_000:
                yield rows()
    yield rows()


_TEMPLATE = "host string, template array<struct<parent: int, slot: int, tokens: array<bigint>>>"


def _nest(table: pa.Table) -> pa.Table:
    rows = table.to_pylist()
    tree = nested([((r["sig"], r["pages"]), r["pages"], r["token"], r["place"]) for r in rows])
    kind = pa.list_(pa.struct([("parent", pa.int32()), ("slot", pa.int32()), ("tokens", pa.list_(pa.int64()))]))
    made = pa.array([[{"parent": p, "slot": s, "tokens": t} for p, s, t in tree]], kind)
    return pa.Table.from_arrays([pa.array([rows[0]["host"]], pa.string()), made], ["host", "template"])


def deduce_templates(pages: DataFrame, page_id: str = "page_id", url: str = "url", source: str = "html", support: int = 5, share: float = 0.5) -> DataFrame:
    """(host, main, template, refuted): each host's main container, the tree of its classes, and the names that don't exclude.

    A class is valid with at least `support` pages and two tokens. Of its tokens those on at least `share` of the host's pages
    are the template's: text blocks, inside article elements only if they stand once a page, and tags that stand once
    a page. The main container directly holds most other text; article and main elements that are on `share` of the pages go
    first, whole. A name's vote is confirmed if its elements are on `support` pages and hold less than half of the host's
    text, else refuted. Hosts with too few pages get none of these.
    """
    short_batches(pages.sparkSession)
    page = F.coalesce(F.col(page_id).cast("string"), F.lit(""))
    facts = pages.select(host_of(F.col(url)).alias("host"), page, F.col(source).cast("string")).mapInArrow(_facts, _FACTS)
    merged = facts.groupBy("host", "token").agg(
        F.max("container").alias("container"), F.max("element").alias("element"), F.max("name").alias("name"), F.sum("sig").alias("sig"), F.sum("pages").alias("pages"), F.min("kind").alias("kind"),
        F.max("most").alias("most"), (F.sum("place") / F.sum("pages")).alias("place"), F.sum("chars").alias("chars"),
    )
    merged = settled(merged.where("pages > 1 or kind in (0, 4) or (kind = 1 and chars > 0)"))
    sizes = merged.where("token = 0").select("host", F.col("pages").alias("total"), F.col("chars").alias("whole"))
    large = sizes.where(F.col("total") >= support)
    tokens = merged.where("kind < 4")
    per_class = tokens.groupBy("host", "sig", "pages").agg(F.count("*").alias("members"))
    valid = tokens.where("kind in (1, 2, 3)").join(per_class, ["host", "sig", "pages"]).join(large, "host").where((F.col("pages") >= support) & (F.col("members") > 1))
    fixed = valid.where((F.col("pages") >= share * F.col("total")) & ((F.col("kind") == 2) | (F.col("most") == 1)))
    templates = fixed.select("host", F.col("sig").cast("string").alias("sig"), "pages", "token", "place").groupBy("host").applyInArrow(_nest, _TEMPLATE)
    fixed = fixed.where("kind > 1")
    constant = fixed.groupBy("host", "container").agg(F.sum("chars").alias("__fixed"))
    held = tokens.where("kind = 1 and chars > 0").join(constant, ["host", "container"], "left").withColumn("chars", F.col("chars") - F.coalesce("__fixed", F.lit(0)))
    held = held.withColumn("hint", F.col("element") != 0).withColumn("main", F.when(F.col("element") != 0, F.col("element")).otherwise(F.col("container")))
    held = held.groupBy("host", "main").agg(F.sum("chars").alias("chars"), F.max("pages").alias("pages"), F.max("hint").alias("hint")).join(large, "host").where(F.col("pages") >= support)
    heaviest = Window.partitionBy("host").orderBy(F.desc(F.col("hint") & (F.col("pages") >= share * F.col("total"))), F.desc("chars"), "main")
    main = held.withColumn("k", F.row_number().over(heaviest)).where("k = 1").select("host", "main")
    votes = merged.where("kind = 4").join(large, "host").where((F.col("pages") < support) | (2 * F.col("chars") >= F.col("whole")))
    refuted = votes.groupBy("host").agg(F.collect_list("name").alias("refuted"))
    made = sizes.select("host", F.when(F.col("total") >= support, F.array().cast("array<string>")).alias("none")).join(main, "host", "left").join(templates, "host", "left").join(refuted, "host", "left")
    return settled(made.select("host", "main", "template", F.coalesce("refuted", "none").alias("refuted")))


def extract_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", source: str = "html", support: int = 5) -> DataFrame:
    """pages with text and n_chars (code points of text) added (same names are replaced).

    Null and empty pages have the empty text; an empty table stays empty. Pages of hosts with few pages are read by the element
    rules alone. Repeated rows give repeated results; null ids and URLs count as empty. Pages of any length are read
    whole: nothing of the article's slots is dropped or cut.
    """
    templates = deduce_templates(pages, page_id, url, source, support)
    bytes_of = F.lit(72) + F.coalesce(F.aggregate("template", F.lit(0), lambda s, c: s + 16 + 8 * F.size(c["tokens"])), F.lit(0)) + F.coalesce(F.length(F.array_join("refuted", ",")), F.lit(0))
    size = templates.agg(F.sum(bytes_of).alias("b")).first()["b"] or 0
    own = templates.select(F.col("host").alias("__host"), F.struct("main", "template", "refuted").alias("__of_host"))
    joined = pages.withColumn("__at", host_of(F.col(url))).join(F.broadcast(own) if size * 4 <= BROADCAST_BYTES else own, F.col("__at") == F.col("__host"), "left")

    known: dict[tuple, frozenset] = {}

    def hashes(names) -> frozenset | None:
        if names is None:
            return None
        key = tuple(names)
        if key not in known:
            if len(known) > 1000:
                known.clear()
            known[key] = frozenset(token_hash(x) for x in key)
        return known[key]

    def texts(sources: pa.Array, hosts: pa.Array, of_hosts: pa.Array) -> pa.Array:
        places: dict = {}
        out = []
        for k, (s, host) in enumerate(zip(sources.to_pylist(), hosts.to_pylist(), strict=True)):
            if host not in places:  # the template of a host is unpacked once a batch
                t = of_hosts[k].as_py() or {"main": None, "template": None, "refuted": None}
                places[host] = t["main"], [(c["parent"], c["slot"], c["tokens"]) for c in t["template"] or ()], hashes(t["refuted"])
            main, template, refuted = places[host]
            out.append(read_page(s or "", refuted).text(main, template))
        return pa.array(out, pa.string())

    texts.__annotations__ = {"sources": pa.Array, "hosts": pa.Array, "of_hosts": pa.Array, "return": pa.Array}
    read = F.arrow_udf(texts, "string").asNondeterministic()
    made = joined.withColumn("__text", read(F.col(source).cast("string"), "__at", "__of_host"))
    return made.withColumns({"text": F.col("__text"), "n_chars": F.length("__text").cast("long")}).drop("__text", "__at", "__host", "__of_host")
