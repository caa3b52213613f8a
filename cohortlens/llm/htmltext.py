"""Operator 1: main text of web pages by equivalence-class template deduction."""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from collections import Counter
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, lean_batches
from .kernels import mix, pieces

#: Elements by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
RAW = frozenset("script style noscript template iframe textarea title svg math".split())
DROPPED = frozenset("head nav footer aside form button select menu dialog object canvas audio video".split()) | RAW
CONTENT = {"main": 1, "article": 2}
#: Words of class, id and role that name menus, adverts, notices, sidebars, comments and the like.
DROPPED_NAMES = frozenset(
    "ad ads advert adverts advertisement sponsor sponsored promo banner cookie cookies consent gdpr notice popup modal newsletter subscribe"
    " nav navbar navigation menu breadcrumb breadcrumbs sidebar footer header masthead comment comments disqus replies social share sharing"
    " related widget contentinfo complementary search alert toolbar pagination".split()
)
#: Within an article or main element a name counts as a whole only: these name what is no text of it,
DROPPED_WITHIN = frozenset(
    "ad ads advert adverts advertisement sponsor sponsored promo banner cookie cookies cookie-notice cookie-banner consent gdpr notice popup modal newsletter newsletter-signup subscribe"
    " nav navbar navigation menu breadcrumb breadcrumbs sidebar footer comment comments comment-list disqus replies share-buttons social-share sharing widget contentinfo complementary toolbar pagination".split()
)
#: and these do where at least half of the element's text is links.
LINKED_WITHIN = frozenset("related related-posts related-articles related-links search share social alert".split())
#: Beginnings of such words where they are written as one.
DROPPED_STARTS = ("adsby", "adslot", "advert", "breadcrumb", "cookie", "footer", "navbar", "navlink", "newsletter", "popup", "sidebar", "sidenav", "sponsor", "topnav")
#: What makes an article or main element one of these, and nothing else does.
DROPPED_ARTICLES = frozenset("ad ads advert comment comments reply replies sponsored promo".split())
NAMED = frozenset("div section ul ol dl p span table header blockquote figure details center".split())
#: Start tags that end an open element of the same name in their container.
CLOSES_SELF = frozenset("p li dt dd tr td th option".split())
#: A template class needs so many pages, and so many tags among its tokens; one of texts alone needs a slot of such a class.
MIN_PAGES, MIN_TAGS = 3, 2
#: A page of whose texts, and of whose characters, more than this is template is a near copy of others: its text is its own.
NEAR_COPY = 0.5
#: A template text within an article goes if so much of it is links, or at its end if it is a label of so many words.
LINKED, LABEL = 0.8, 5
#: An article of less than this share of the other text is a teaser.
TEASER = 0.25
#: Up to so many template tokens (8 bytes each) are broadcast.
BROADCAST_TOKENS = 1 << 21

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|<(/?)([A-Za-z][A-Za-z0-9:-]*)([^>]*)>", re.S)
_NAMES = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_HOST = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://)?(?:[^/?#@]*@)?([^/?#:]*)"


def host_of(url: str) -> Column:
    """The host of the URL in a column in lower case, without a leading ``www.``; empty for null."""
    return F.regexp_replace(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), _HOST, 1)), "^www[.]", "")


def _hash(text: str, path: int = 0) -> int:
    return int.from_bytes(blake2b(text.encode(), digest_size=8, salt=path.to_bytes(8, "little")).digest(), "little")


class Page:
    """The tokens of a page: tags and text blocks, each with the place where it stands.

    ``blocks`` are (token, text, within content, dropped, link characters,
    doubt): text runs between block tags, with inline tags left out and
    references still in place. ``stream`` has the tokens of start tags (odd)
    and of blocks (even) in their order. A token stands for an element and the
    block around it and, for a block, its text. ``doubt`` numbers elements
    that are dropped if their text is mostly links.
    """

    def __init__(self, source: str, cache: dict[str, int]):
        self.stream: list[int] = []
        self.blocks: list[tuple[int, str, int, bool, int, int]] = []
        self.has_content = 0
        self.cache = cache
        stack: list[tuple[str, str, int, bool, int]] = []  # name, path, 2 in an article or 1 in main, dropped, doubt
        run: list[str] = []
        at = linked = doubts = 0

        def flush():
            nonlocal linked
            if run:
                text = "".join(run)
                run.clear()
                if text and not text.isspace():
                    _, path, inside, dropped, doubt = stack_of_blocks() or ("", "", 0, False, 0)
                    self.stream.append(self._with_text(self._token(path), text))
                    self.blocks.append((self.stream[-1], text, inside, dropped, linked, doubt))
                linked = 0

        def put(text: str):
            nonlocal linked
            run.append(text)
            if any(x[0] == "a" for x in stack):
                linked += len(text)

        def stack_of_blocks():
            return next((x for x in reversed(stack) if x[0] not in INLINE or x[3]), None)

        while m := _TOKEN.search(source, at):
            end, name, rest = m.group(1, 2, 3) if m.group(2) else m.group(4, 5, 6)
            name = name.lower() if name else None
            if m.start() > at:
                put(source[at : m.start()])
            at = m.end()
            if name is None:
                continue
            if name == "br" or name == "hr":
                run.append(" ")
                continue
            if name in VOID:
                continue
            block = name not in INLINE
            if end:
                for depth in range(len(stack) - 1, -1, -1):
                    if stack[depth][0] == name:
                        if block or any(x[3] != stack[depth - 1][3] for x in stack[depth:] if depth):
                            flush()
                        del stack[depth:]
                        break
                else:
                    if block:
                        flush()
                continue
            above = stack[-1] if stack else ("", "", 0, False, 0)
            drop, doubtful = self._named(name, rest, above)
            drop |= name in DROPPED
            if block or drop != above[3]:
                flush()
            if name in RAW:
                self.stream.append(self._token(self._below(above, name)) | 1)
                if not rest.endswith("/"):  # its content is no markup: on to its end
                    closing = re.compile(rf"</{name}\s*>", re.I).search(source, at)
                    at = closing.end() if closing else len(source)
                continue
            if name in CLOSES_SELF:
                for depth in range(len(stack) - 1, -1, -1):
                    if stack[depth][0] == name:
                        del stack[depth:]
                        break
                    if stack[depth][0] not in INLINE:
                        break
                above = stack[-1] if stack else ("", "", 0, False, 0)
            content = 0 if above[3] or drop else CONTENT.get(name, 0)
            self.has_content = max(self.has_content, content)
            path = self._below(above, name)
            doubts += doubtful
            if block:
                self.stream.append(self._token(path) | 1)
            if not rest.endswith("/"):
                stack.append((name, path if block else above[1], max(above[2], content), above[3] or drop, above[4] or (doubts if doubtful else 0)))
        if at < len(source):
            put(source[at:])
        flush()

    @staticmethod
    def _below(above, name: str) -> str:
        return f"{above[1].rpartition('/')[2]}/{name}"

    def _token(self, path: str) -> int:
        if path not in self.cache:
            self.cache[path] = _hash(path)
        return self.cache[path]

    @staticmethod
    def _named(name: str, rest: str, above) -> tuple[bool, bool]:
        """Whether an element's names say that it is no text, and whether they say so if it is mostly links."""
        if name == "header":
            return not above[2], False  # an article's own header holds its headline
        if name not in NAMED and name not in CONTENT or "=" not in rest:
            return False, False
        values = [(m.group(2) or m.group(3) or m.group(4) or "") for m in _NAMES.finditer(rest)]
        if above[2] and name not in CONTENT:
            whole = {w for v in values for w in v.lower().split()}
            return not DROPPED_WITHIN.isdisjoint(whole), not LINKED_WITHIN.isdisjoint(whole)
        words = [w.lower() for v in values for w in _WORD.findall(v)]
        names = DROPPED_ARTICLES if name in CONTENT else DROPPED_NAMES
        return not names.isdisjoint(words) or name not in CONTENT and any(w.startswith(DROPPED_STARTS) for w in words), False

    @staticmethod
    def _with_text(token: int, text: str) -> int:
        return _hash(" ".join(text.split()), token) & ~1

    def main_text(self, template: np.ndarray) -> str:
        """The text of the slots, which is all that isn't among the sorted template tokens: of the article, or else of main, or else of whatever isn't dropped.

        An article keeps what pages share, but for template texts that are
        links, or labels at its end. Elsewhere template texts go. Where they
        are most of what would be the text, nothing goes: pages that share so
        much are near copies. Beside an article or
        main element of a few words, all that isn't dropped is the text.
        """
        size, links = Counter(), Counter()
        for b in self.blocks:
            size[b[5]] += len(b[1])
            links[b[5]] += b[4]
        there = [b for b in self.blocks if not b[3] and not (b[5] and 2 * links[b[5]] >= size[b[5]])]
        fixed, _ = _find(template, np.array([b[0] for b in there], np.uint64))
        length = np.array([len(b[1]) for b in there], np.int64)
        inside = np.array([b[2] for b in there], np.int64)
        content = inside == self.has_content
        chosen = content
        if self.has_content:
            goes = fixed & (np.array([b[4] for b in there], np.int64) >= LINKED * length)
            for i in np.flatnonzero(content)[::-1]:
                if not fixed[i] or len(there[i][1].split()) > LABEL or there[i][1].rstrip().endswith((".", "!", "?", ":", "…", "。")):
                    break
                goes[i] = True
            fixed = np.where(content, goes, fixed)
            if length[content].sum() < TEASER * length[~content & ~fixed].sum():
                chosen = np.ones(len(there), bool)
        lost = chosen & fixed
        if lost.sum() > NEAR_COPY * chosen.sum() and length[lost].sum() > NEAR_COPY * length[chosen].sum():
            fixed[:] = False
        return " ".join(entities.unescape(" ".join(b[1] for b, c in zip(there, (chosen & ~fixed).tolist(), strict=True) if c)).split())


def _find(table: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each value is in the sorted table, and where."""
    if not len(table):
        return np.zeros(len(values), bool), np.zeros(len(values), np.int64)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return table[at] == values, at


def page_streams(pages: DataFrame) -> DataFrame:
    """(host, number, stream): the tokens of each distinct content of a host, in their order and 8 bytes each; tags are odd, texts even."""

    def streams(batches):
        cache: dict[str, int] = {}
        for batch in pieces(batches, 2):
            found: dict[tuple[str, int], bytes] = {}
            for number, host, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                key = host, number
                if key not in found:
                    found[key] = np.array(Page(source or "", cache).stream, np.uint64).tobytes()
                if len(cache) > 100_000:
                    cache.clear()
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.int64()), pa.array(found.values(), pa.binary())], names=["host", "number", "stream"]
            )

    rows = pages.select(F.xxhash64("html").alias("number"), host_of("url").alias("host"), "html").mapInArrow(streams, "host string, number long, stream binary")
    return rows.groupBy("host", "number").agg(F.first("stream").alias("stream"))


def _counted(streams: DataFrame) -> DataFrame:
    """(host, token, class, pages, at): tokens by their occurrence vectors.

    A vector has, for each page of the host, how often the token occurs there;
    copies of a page are one page, whatever their ids and URLs. Vectors are
    compared by the xor of a hash of each page and count, so a token is one row
    in each task and one in all. ``at`` is the token's place in the page of
    least hash, which is the same page for all tokens of a class.
    """

    def tokens(batches):
        for batch in pieces(batches, 2):
            seen: dict[tuple[str, int], list[int]] = {}
            for host, number, stream in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                keys, first, times = np.unique(np.frombuffer(stream, np.uint64), return_index=True, return_counts=True)
                place = mix(mix(np.array([number], np.int64).view(np.uint64)) + times.astype(np.uint64))
                at = np.minimum(first, (1 << 24) - 1) + ((number & ((1 << 39) - 1)) << 24)
                for k, h, a in zip(keys.tolist(), place.tolist(), at.tolist(), strict=True):
                    entry = seen.setdefault((host, k), [0, 0, a])
                    entry[0] ^= h
                    entry[1] += 1
                    entry[2] = min(entry[2], a)
            keys, values = list(seen), list(seen.values())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([k[0] for k in keys], pa.string()),
                    pa.array(np.array([k[1] for k in keys], np.uint64).view(np.int64)),
                    pa.array(np.array([v[0] for v in values], np.uint64).view(np.int64)),
                    pa.array([v[1] for v in values], pa.int64()),
                    pa.array([v[2] for v in values], pa.int64()),
                ],
                names=["host", "token", "vector", "pages", "at"],
            )

    rows = streams.mapInArrow(tokens, "host string, token long, vector long, pages long, at long")
    whole = rows.groupBy("host", "token").agg(F.bit_xor("vector").alias("vector"), F.sum("pages").alias("pages"), F.min("at").alias("at"))
    return whole.select("host", "token", F.xxhash64("vector", "pages").alias("class"), "pages", "at")


def _nesting(stream: np.ndarray, table: tuple[np.ndarray, ...], tell) -> None:
    """Tells of a page's classes (class, token or None, low, high): a token out of its class's order has itself, a class
    the hash of the slot that each of its rounds lies in, and low < high where it crosses a class of more pages or tokens."""
    hit, at = _find(table[0], stream)
    at = at[hit].tolist()
    tokens, classes, pages, places = table[0], table[1], table[2], table[3]
    seen: Counter[int] = Counter()
    rounds: dict[int, list[tuple[int, int, int]]] = {}
    for t in at:
        rounds.setdefault(int(classes[t]), []).append((seen[t], int(places[t]), t))
        seen[t] += 1
    out: set[int] = set()
    for c, keys in rounds.items():
        if any(a >= b for a, b in zip(keys, keys[1:], strict=False)):
            # what isn't in a longest increasing run stands elsewhere than in other rounds or pages
            ends, last, before = [], [], []
            for i, key in enumerate(keys):
                k = bisect_left(ends, key)
                ends[k : k + 1], last[k : k + 1] = [key], [i]
                before.append(last[k - 1] if k else -1)
            i, kept = last[-1], set()
            while i >= 0:
                kept.add(i)
                i = before[i]
            for t in {key[2] for i, key in enumerate(keys) if i not in kept}:
                out.add(t)
                tell(c, int(tokens[t]), 0, 0)
    size = Counter(int(classes[t]) for t in seen if t not in out)
    lost: set[int] = set()
    open_: list[list[int]] = []  # class, place of its last token, tokens to come in this round
    for t in at:
        c, place = int(classes[t]), int(places[t])
        if t in out or c in lost:
            continue
        depth = next((i for i in range(len(open_) - 1, -1, -1) if open_[i][0] == c), None)
        if depth is None:
            slot = hash((open_[-1][0], open_[-1][1])) if open_ else 0
            tell(c, None, slot, slot)
            open_.append([c, place, size[c]])
            depth = len(open_) - 1
        elif depth < len(open_) - 1:
            weight = {x[0]: (int(pages[rounds[x[0]][0][2]]), size[x[0]], x[0]) for x in open_[depth:]}
            inner = [x[0] for x in open_[depth + 1 :]]
            for g in [c] if any(weight[x] > weight[c] for x in inner) else inner:
                lost.add(g)
                tell(g, None, 0, 1)
            open_[:] = [x for x in open_ if x[0] not in lost]
            if c in lost:
                continue
        open_[depth][1] = place
        open_[depth][2] -= 1
        if not open_[depth][2]:
            del open_[depth]


def _invalid(streams: DataFrame, table: DataFrame, min_tags: int, broadcast_tokens: int) -> DataFrame:
    """(host, class, token): tokens of classes that aren't ordered; with a null token, classes that aren't nested, which is in one slot of one class or of none.
    Classes of fewer than ``min_tags`` tags must have such a slot."""

    def work(batches, table_of):
        for batch in pieces(batches, 2):
            told: dict[tuple[str, int, int | None], list[int]] = {}
            owns = list(zip(*[c.to_pylist() for c in batch.columns[3:]], strict=True)) or [None] * batch.num_rows
            for host, stream, own in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), owns, strict=True):

                def tell(c, token, low, high, host=host):
                    ends = told.setdefault((host, c, token), [low, high])
                    ends[:] = min(ends[0], low), max(ends[1], high)

                _nesting(np.frombuffer(stream, np.uint64), table_of(host, own), tell)
            signed = [None if k[2] is None else k[2] - (1 << 64 if k[2] >> 63 else 0) for k in told]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([k[0] for k in told], pa.string()), pa.array([k[1] for k in told], pa.int64()), pa.array(signed, pa.int64()),
                    pa.array([v[0] for v in told.values()], pa.int64()), pa.array([v[1] for v in told.values()], pa.int64()),
                ],
                names=["host", "class", "token", "low", "high"],
            )

    named = [F.col("host"), F.col("number"), F.col("stream")]
    rows = _beside(streams, named, F.col("host"), F.xxhash64("number"), table.select("host", "token", "class", "pages", "at"), broadcast_tokens, work, "host string, class long, token long, low long, high long")
    ends = rows.groupBy("host", "class", "token").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    tags = table.groupBy("host", "class").agg(F.count_if(F.expr(_IS_TAG)).alias("tags"))
    alone = (F.col("tags") < min_tags) & (F.col("low") == 0)  # in no slot of another class
    return ends.join(tags, ["host", "class"]).where(F.col("token").isNotNull() | (F.col("low") != F.col("high")) | alone).select("host", "class", "token")


_IS_TAG = "(token & 1) = 1"


def template_tokens(pages: DataFrame, min_pages: int = MIN_PAGES, min_tags: int = MIN_TAGS, broadcast_tokens: int = BROADCAST_TOKENS) -> DataFrame:
    """(host, token): text tokens of the hosts' templates.

    Tokens of equal occurrence vectors form a class. A class is valid on
    ``min_pages`` pages of different content or more, with ``min_tags`` tags or
    more or else in a slot of another class, if it is ordered (on every page
    its tokens come in rounds of one order) and nested (each round lies within
    one slot, the same on all pages, of another class, or in none). Tokens out
    of order leave their class, and classes that cross others or change their
    slot go, until all are valid; the valid classes are the template.
    """
    streams = checkpointed(page_streams(pages))
    table = checkpointed(_counted(streams).where(F.col("pages") >= min_pages))
    while True:
        bad = checkpointed(_invalid(streams, table, min_tags, broadcast_tokens))
        if bad.isEmpty():
            return table.where(f"NOT ({_IS_TAG})").select("host", "token")
        table = table.join(bad.where("token is not null").select("host", "token"), ["host", "token"], "left_anti")
        table = checkpointed(table.join(bad.where("token is null").select("host", "class"), ["host", "class"], "left_anti"))


def _beside(rows: DataFrame, named: list, host, salt, table: DataFrame, broadcast_tokens: int, work, schema: str) -> DataFrame:
    """work(batches, table_of) of the named columns, where table_of(host, own) has the sorted columns of a host in table (host, token, ...).

    Tables go to all tasks if they are few tokens in all. Beyond that they are
    joined to the rows by host, with the rows of hosts that have a 64th of
    all rows or more (there are 64 at most) dealt to 64 salts each.
    """
    columns = table.columns[1:]

    def arrays(own) -> tuple[np.ndarray, ...]:
        cut = [np.array([] if own is None or c is None else c, np.int64) for c in (own or [None] * len(columns))]
        first = cut[0].view(np.uint64)
        order = np.argsort(first)
        return first[order], *[c[order] for c in cut[1:]]

    lists = table.groupBy(F.col("host").alias("__host")).agg(*[F.collect_list(c).alias(f"__{c}") for c in columns])
    if table.count() <= broadcast_tokens:
        by_host = {row[0]: arrays(row[1:]) for row in lists.toLocalIterator()}
        sent, none = rows.sparkSession.sparkContext.broadcast(by_host), arrays(None)
        return rows.select(*named).mapInArrow(lambda batches: work(batches, lambda h, own: sent.value.get(h, none)), schema)
    keyed = rows.select(*named, host.alias("__host"), salt.alias("__spread"))
    total = keyed.count()
    hot = keyed.groupBy("__host").agg(F.count("*").alias("n")).where(F.col("n") * 64 >= total).select("__host", F.lit(64).alias("__salts"))
    keyed = keyed.join(F.broadcast(hot), "__host", "left").withColumn("__salt", F.pmod("__spread", F.coalesce("__salts", F.lit(1))))
    spread = lists.join(F.broadcast(hot), "__host", "left").withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), (F.coalesce("__salts", F.lit(1)) - 1).cast("long"))))
    joined = keyed.join(spread.drop("__salts"), ["__host", "__salt"], "left").select(*named, *[f"__{c}" for c in columns])
    return joined.mapInArrow(lambda batches: work(batches, lambda h, own: arrays(own)), schema)


def extract_text(pages: DataFrame, broadcast_tokens: int = BROADCAST_TOKENS) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of pages.

    All pages lose the template of their host; what remains lies in its slots.
    Of these, those in an ``article`` or ``main`` element are chosen where a
    page has one, and those in elements that name menus, adverts, notices,
    forms, comments and the like are not. What an article repeats from others
    stays (see ``Page.main_text``). A null or empty html has an empty
    text; repeated rows are separate pages that count once in their host's
    template; a null url is a host of its own. Pages may be of any length;
    other columns of pages aren't read.
    """
    lean_batches(pages.sparkSession)
    templates = checkpointed(template_tokens(pages, broadcast_tokens=broadcast_tokens))
    schema = f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long"
    return _beside(pages, [F.col("page_id"), F.col("url"), F.col("html"), host_of("url").alias("host")], host_of("url"), F.xxhash64("page_id", "url"), templates, broadcast_tokens, _texts, schema)


def _texts(batches, table_of):
    cache: dict[str, int] = {}
    for batch in pieces(batches, 2):
        sources = batch.column(2).to_pylist()
        owns = batch.column(4).to_pylist() if batch.num_columns > 4 else [None] * len(sources)
        texts = []
        for host, source, own in zip(batch.column(3).to_pylist(), sources, owns, strict=True):
            template = table_of(host, own and [own])[0]
            texts.append(Page(source or "", cache).main_text(template))
            if len(cache) > 100_000:
                cache.clear()
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])
