"""Main text of web pages by templates deduced from the pages of a host.

All pages of a host that have tags are taken as made from one template. A token is a tag with the path of tags above it, a
word with its path, or a whole block of text with its path, which tells words of the template from the same words in the
article. Tokens are counted over the pages by sums that Spark adds up in any order, so no host's pages have to meet in one
place. Tags that stand exactly once on most pages are the outermost part of the template; one is valid there if its parents
are too. Blocks that are on most pages, and words exactly once on every page (those with the page's own vector of
occurrences), are part of the template, not of the content. The deepest container that holds most of the host's text is the
main slot and is extracted from each page, without the parts that fixed lists of tags and names give as menus, notices,
adverts and the like. Classes with other vectors of occurrences, and the slots between them, are not deduced: these lists
stand in for them.
"""

from __future__ import annotations

import hashlib
import html as references
import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from watchmill.llm.common import map_frames, materialize, table

#: Hosts with fewer pages use the template of all hosts, which stands under this name.
LEAST_PAGES, ALL_HOSTS = 8, "*"
#: A container holds the main slot if it has at least this share of the text of its host's pages.
MAIN_SHARE = 0.5
#: Share of a host's pages with tags that a tag or a block of its template is on.
SUPPORT = 0.8

# Tags by what they do to text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 "
    "h6 header hr html legend li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CONTAINERS = frozenset("article body div main section table tbody td tr".split())
DROPPED = frozenset(
    "aside audio button canvas datalist dialog embed fieldset footer form head header iframe input label legend map menu nav "
    "noscript object option script select style svg template textarea title video".split()
)
#: Names in a class, id or role that stand for something other than the article, also as compounds with each other and HELPERS.
NAMED = frozenset(
    "ad ads advert adverts advertisement advertising alert author-box banner breadcrumb breadcrumbs byline comment comments "
    "consent cookie cookies disclaimer discussion disqus footer gdpr header login masthead menu modal nav navbar navigation "
    "newsletter notice notification overlay pagination pager paywall popup promo promotion recommended related replies reply "
    "respond search share sharing sidebar signup social sponsor sponsored subscribe subscription tags toolbar widget".split()
)
HELPERS = frozenset(
    "area bar block bottom box button buttons container count form global icon icons inner item items left link links list main "
    "message outer page panel post posts primary right row secondary section site slot top unit wrap wrapper zone".split()
)
#: Tags that show that a named container is more than an advert or a menu.
PROSE = frozenset("article h1 h2 main p".split())
#: Tags that end an open one of the same group.
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

RAW = ("script", "style", "textarea", "title", "noscript", "iframe", "svg")
#: Parts that are no tags: comments, elements whose content is no markup, declarations.
OTHERS = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{"|".join(RAW)})\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)|<[!?][^>]*>",
    re.DOTALL | re.IGNORECASE,
)
TAG = re.compile(r"<(/?)([a-z][a-z0-9:-]*)", re.IGNORECASE)
#: Characters that end a tag or hide its end.
MARKS = re.compile("[>\"']")
#: So much of the end of a path stands in a token, for reading; paths are told apart by their ids.
SHOWN = 200
NAMES = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)

#: What is added up for every token.
SUMS = ("pages", "once", "n", "v1", "v2", "chars")


@dataclass
class Node:
    tag: str
    index: int
    dropped: bool
    named: int
    #: Place in the stack of the nearest tag, this one included, that may end or stop the ending of others; -1 without one.
    solid: int


@dataclass
class Parsed:
    """What a page is made of: a node for each tag, with the id of its path and the node above it, how often each tag path
    opens, and the texts that are kept, with node (-1 outside of all tags) and block number.
    """

    ids: list[str] = field(default_factory=list)
    parents: list[int] = field(default_factory=list)
    tokens: list[str] = field(default_factory=list)
    texts: list[tuple[int, int, str]] = field(default_factory=list)

    def path(self, node: int) -> str:
        return self.ids[node] if node >= 0 else ""


def _named(tag: str, rest: str) -> tuple[str, bool]:
    """The tag with its classes, as it stands in a path, and whether its names say that it is no part of the article."""
    label, named = tag, False
    for match in NAMES.finditer(rest):
        words = (match[2] or match[3] or match[4] or "").lower().split()
        if match[1].lower() == "class" and words:
            label = f"{tag}.{'.'.join(sorted(words))}"
        named = named or any(map(_is_name, words))
    return label, named


def _is_name(word: str) -> bool:
    pieces = [p for p in re.split(r"[-_]+", word) if not p.isdigit()]
    return word in NAMED or (not NAMED.isdisjoint(pieces) and all(p in NAMED or p in HELPERS for p in pieces))


def _tag_ends(html: str) -> tuple[list[int], list[int]]:
    """Places of all MARKS, and for each one where a tag ends that is read on from there, outside of quotes; -1 for nowhere."""
    places = [mark.start() for mark in MARKS.finditer(html)]
    ends, following = [-1] * (len(places) + 1), {}
    for i in range(len(places) - 1, -1, -1):
        mark = html[places[i]]
        if mark == ">":
            ends[i] = places[i]
        else:
            ends[i] = ends[following[mark] + 1] if mark in following else -1
            following[mark] = i
    return places, ends


def _parts(html: str) -> Iterator[tuple[str | None, bool, str]]:
    """(tag, is an end tag, attributes) and (None, False, text) of a page in order, in time that grows with its length alone."""
    places, ends = _tag_ends(html)
    last, at = html.rfind(">"), 0
    while at < len(html):
        if html[at] != "<":
            stop = html.find("<", at)
            stop = stop if stop >= 0 else len(html)
            yield None, False, html[at:stop]
            at = stop
            continue
        if at > last:  # nothing but a comment can begin here
            comment = html.find("<!--", at)
            yield None, False, html[at : comment if comment >= 0 else len(html)]
            return
        tag = TAG.match(html, at)
        other = OTHERS.match(html, at) if tag is None or tag[2].lower().startswith(RAW) else None
        if other is not None:
            at = other.end()
            continue
        end = ends[bisect_left(places, tag.end())] if tag is not None else -1
        if end < 0:
            yield None, False, "<"
            at += 1
            continue
        yield tag[2].lower(), bool(tag[1]), html[tag.end() : end]
        at = end + 1


def parse(html: str | None) -> Parsed:
    """Walk through a page. Missing end tags are supplied, and end tags without a beginning are passed over.

    Containers whose names say that they are no part of the article are left out, but not one with prose that holds most of
    the page's text. A header inside an article belongs to it.
    """
    page, stack, block = Parsed(), [], 0
    shown, known, opened = [], {}, Counter()
    texts: list[tuple[int, tuple[int, int, str]]] = []
    above_name, prose = [0], [False]  # of each named container: the one around it (0: none), and whether it holds PROSE

    def cut(depth: int) -> None:
        for node in stack[depth:]:
            opened[node.tag] -= 1
        del stack[depth:]

    for tag, is_end, rest in _parts(html or ""):
        top = stack[-1] if stack else None
        if tag is None:
            if top is None or not top.dropped:
                texts.append((top.named if top else 0, (top.index if top else -1, block, references.unescape(rest))))
            continue
        block += tag in BLOCKS
        if tag == "br" and top is not None and not top.dropped:
            texts.append((top.named, (top.index, block, " ")))
        if is_end:
            if opened[tag] > 0:
                depth = len(stack) - 1
                while stack[depth].tag != tag:
                    depth -= 1
                cut(depth)
            continue
        closing = CLOSED_BY.get(tag) or ({"p"} if tag in BLOCKS else set())
        at = top.solid if top is not None and closing else -1
        while at >= 0:
            if stack[at].tag in closing:
                cut(at)
                break
            if stack[at].tag in BLOCKS and stack[at].tag != "p":
                break
            at = stack[at - 1].solid if at else -1
        label, named = _named(tag, rest) if rest else (tag, False)
        top = stack[-1] if stack else None
        above = top.index if top else -1
        step = (page.path(above), label)
        if step not in known:
            known[step] = hashlib.blake2b("/".join(step).encode("utf-8", "replace"), digest_size=8).hexdigest()
        index = len(page.ids)
        page.ids.append(known[step])
        page.parents.append(above)
        shown.append(f"{shown[above][0]}/{label}"[-SHOWN:] if top else label[-SHOWN:])
        shown[-1] = (shown[-1], shown[above][1] + 1 if top else 0)
        page.tokens.append(f"<{known[step]}|{step[0]}|{shown[-1][1]}|{tag}|{shown[-1][0]}")
        dropped = (top.dropped if top else False) or (tag in DROPPED and not (tag == "header" and opened["article"] > 0))
        within = top.named if top else 0
        if tag in PROSE:
            name = within
            while name and not prose[name]:
                prose[name], name = True, above_name[name]
        if named and tag not in ("html", "body", "main", "article"):
            above_name.append(within)
            prose.append(False)
            within = len(above_name) - 1
        if tag not in VOID and not rest.endswith("/"):
            solid = len(stack) if (tag in BLOCKS or tag == "option") and tag not in ("tbody", "thead") else top.solid if top else -1
            stack.append(Node(tag, index, dropped, within, solid))
            opened[tag] += 1
    held, whole = [0] * len(above_name), 0
    for name, (_, _, text) in texts:
        size = sum(map(len, text.split()))
        whole += size
        held[name] += size
    for name in range(len(above_name) - 1, 0, -1):
        held[above_name[name]] += held[name] if above_name[name] else 0
    kept = [True] * len(above_name)
    for name in range(1, len(above_name)):
        kept[name] = kept[above_name[name]] and prose[name] and 2 * held[name] > whole
    page.texts += [text for name, text in texts if kept[name]]
    return page


def _blocks(page: Parsed) -> dict[int, str]:
    """The token of each block that has text: a digest of its path and its words."""
    parts: dict[int, list[str]] = {}
    for node, block, text in page.texts:
        parts.setdefault(block, [page.path(node)]).append(text)
    words = {block: "".join(texts).split() for block, (_, *texts) in parts.items()}
    return {b: f"#{hashlib.blake2b(' '.join([parts[b][0], *w]).encode('utf-8', 'replace'), digest_size=8).hexdigest()}" for b, w in words.items() if w}


def _page_tokens(page: Parsed) -> tuple[Counter, Counter]:
    """Occurrences of every tag path and block of a page, and the characters of kept text below every tag path."""
    tokens, chars, sizes = Counter(page.tokens), Counter(), [0] * len(page.ids)
    for node, _, text in page.texts:
        if node >= 0:
            sizes[node] += sum(map(len, text.split()))
    for node in range(len(sizes) - 1, -1, -1):
        if sizes[node]:
            chars[page.tokens[node]] += sizes[node]
            if page.parents[node] >= 0:
                sizes[page.parents[node]] += sizes[node]
    tokens.update(_blocks(page).values())
    return tokens, chars


def _words_once(page: Parsed, among: set[str] | None) -> set[str]:
    """Words with their paths that stand exactly once on a page; with ``among``, those of them that are in it."""
    if among is not None and not among:
        return among
    found: Counter = Counter()
    for node, _, text in page.texts:
        path = page.path(node)
        found.update([f"{path}>{word}" for word in text.split()] if among is None else [t for t in (f"{path}>{w}" for w in text.split()) if t in among])
    return {token for token, n in found.items() if n == 1}


def host_of(url: F.Column) -> F.Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def token_vectors(pages: DataFrame) -> DataFrame:
    """(host, token, pages, once, n, v1, v2, chars) for the tokens of all pages (host, key, html) of each host.

    v1 and v2 stand for the vector of occurrences, ``once`` counts the pages with one occurrence. The empty token stands for
    the page itself. Pages without tags have no template and do not count. Of words only those on every page of a batch are
    sent on, as others cannot be on every page.
    """

    def over(frame: pd.DataFrame) -> pd.DataFrame:
        sums: dict[tuple[str, str], list[int]] = {}
        words: dict[str, set[str]] = {}
        for host, key, html in zip(frame["host"], frame["key"], frame["html"]):
            page = parse(html)
            if not page.ids:
                continue
            tokens, chars = _page_tokens(page)
            tokens[""] = 1
            digests = {n: (zlib.crc32(f"{key}|{n}".encode()), zlib.adler32(f"{n}|{key}".encode())) for n in set(tokens.values())}
            for token, n in tokens.items():
                row = sums.setdefault((host, token), [0, 0, 0, 0, 0, 0])
                for i, value in enumerate((1, int(n == 1), n, *digests[n], chars.get(token, 0))):
                    row[i] += value
            words[host] = _words_once(page, words.get(host))
        rows = [(h, t, *row) for (h, t), row in sums.items()]
        # A word once on every page has the vector of the page itself.
        rows += [(h, t, *sums[h, ""][:5], 0) for h, tokens in words.items() for t in tokens]
        return pd.DataFrame(rows, columns=["host", "token", *SUMS])

    schema = f"host string, token string, {', '.join(f'{name} long' for name in SUMS)}"
    return map_frames(pages, over, schema).groupBy("host", "token").agg(*(F.sum(name).alias(name) for name in SUMS))


def deduce_templates(pages: DataFrame) -> DataFrame:
    """(host, size, main, main_id, words, blocks): one row for each host, and one for all of them.

    ``main_id`` is the deepest container of the outermost class that holds most text, ``main`` the end of its path; ``words`` are the words that
    stand once on every page, with their paths, and ``blocks`` the blocks on most pages. Only tags whose parents are in the
    class too nest in it.
    """
    of_hosts = materialize(token_vectors(pages), "token-vectors")
    of_all = of_hosts.groupBy("token").agg(*(F.sum(name).alias(name) for name in SUMS))
    tokens = of_hosts.unionByName(of_all.withColumn("host", F.lit(ALL_HOSTS)))
    of_page = tokens.where("token = ''").select("host", F.col("pages").alias("size"), F.col("v1").alias("w1"), F.col("v2").alias("w2"))
    is_tag, is_block = F.col("token").startswith("<"), F.col("token").startswith("#")
    enough = F.when(is_tag, F.col("once")).otherwise(F.col("pages")) >= SUPPORT * F.col("size")
    of_every = (F.col("pages") == F.col("size")) & (F.col("n") == F.col("pages")) & (F.col("v1") == F.col("w1")) & (F.col("v2") == F.col("w2"))
    outermost = tokens.where("token <> ''").join(of_page, "host").where(F.when(is_tag | is_block, enough).otherwise(of_every))
    outermost = materialize(outermost.where(is_tag | (F.col("size") >= LEAST_PAGES)).select("host", "size", "token", "chars"), "outermost")
    tags = outermost.where(F.col("token").startswith("<")).select("host", "size", "token", "chars")
    named = F.split("token", r"\|", 5)  # <id, id of the parent, depth, tag, end of the path
    tags = tags.select("host", "size", "chars", F.substr(named[0], F.lit(2)).alias("id"), named[1].alias("parent"), named[2].cast("int").alias("depth"), named[3].alias("tag"), named[4].alias("path"))
    above = tags.select("host", F.col("id").alias("parent"))
    nested = tags.where("parent <> ''").join(above, ["host", "parent"], "left_semi").select(*tags.columns).unionByName(tags.where("parent = ''"))
    whole = tags.groupBy("host").agg(F.max("chars").alias("whole"))
    holding = nested.join(whole, "host").where(F.col("tag").isin(*sorted(CONTAINERS)) & (F.col("chars") >= MAIN_SHARE * F.col("whole")) & (F.col("whole") > 0))
    deepest = F.max_by(F.struct("path", "id"), F.struct("depth", "chars", "id"))
    main = holding.groupBy("host").agg(deepest.alias("deepest")).select("host", F.col("deepest.path").alias("main"), F.col("deepest.id").alias("main_id"))
    words = F.sort_array(F.collect_set(F.when(~is_block, F.col("token")))).alias("words")
    fixed = outermost.where(~is_tag).groupBy("host").agg(words, F.sort_array(F.collect_set(F.when(is_block, F.col("token")))).alias("blocks"))
    return of_page.select("host", "size").join(main, "host", "left").join(fixed, "host", "left")


def extract_page(html: str | None, main: str | None, template_words: frozenset[str] = frozenset(), template_blocks: frozenset[str] = frozenset()) -> str:
    """Text of a page's main slot, given by its id: one line for each block, without blocks that are template or made of its words.

    A page without that slot gives all its kept text, and a page that is all template, such as one of many copies, gives that.
    """
    page = parse(html)
    held = [False]
    for path, parent in zip(page.ids, page.parents):
        held.append(path == main or held[parent + 1])
    inside = [t for t in page.texts if held[t[0] + 1]]
    if not any(t[2].strip() for t in inside):
        inside = page.texts
    lines, every, blocks, named = [], [], {}, _blocks(page) if template_blocks else {}
    for node, block, text in inside:
        blocks.setdefault(block, []).append((page.path(node), text))
    for block, parts in blocks.items():
        words = "".join(text for _, text in parts).split()
        fixed = template_words and all(f"{path}>{word}" in template_words for path, text in parts for word in text.split())
        if words:
            every.append(" ".join(words))
            if not fixed and named.get(block) not in template_blocks:
                lines.append(every[-1])
    return "\n".join(lines or every)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page; a null or empty html has an empty text.

    Pages of hosts with fewer than LEAST_PAGES pages use the template of all hosts, which has a place of its own and holds for
    pages without a url too. Repeated rows and rows without page_id are pages like any other; extra columns are left out.
    """
    known = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    known = known.withColumn("host", host_of(F.col("url")))
    keyed = known.select("host", F.xxhash64("page_id", "url", "html").alias("key"), "html")
    templates = materialize(deduce_templates(keyed), "templates")
    common = templates.where(F.col("host") == ALL_HOSTS).select(F.col("main_id").alias("common_main"), F.col("words").alias("common_words"), F.col("blocks").alias("common_blocks"))
    own = templates.where((F.col("size") >= LEAST_PAGES) & (F.col("host") != ALL_HOSTS)).withColumn("own", F.lit(True))
    row = common.collect()  # one row: the tags and words that are on every page of all hosts
    general = (row[0]["common_main"], frozenset(row[0]["common_words"] or ()), frozenset(row[0]["common_blocks"] or ())) if row else (None,)
    joined = known.join(own, "host", "left").select("page_id", "url", "html", "main_id", "words", "blocks", F.coalesce("own", F.lit(False)).alias("own"))

    def over(frame: pd.DataFrame) -> pd.DataFrame:
        found = []
        for html, main, words, blocks, own in zip(frame["html"], frame["main_id"], frame["words"], frame["blocks"], frame["own"]):
            held = (frozenset(tokens) if tokens is not None else frozenset() for tokens in (words, blocks))
            found.append(extract_page(html, main, *held) if own else extract_page(html, *general))
        return pd.DataFrame({"page_id": frame["page_id"].astype("Int64"), "url": frame["url"], "text": found})

    return map_frames(joined, over, "page_id long, url string, text string").withColumn("n_chars", F.length("text").cast("long"))


def op4_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
