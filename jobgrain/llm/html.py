"""Main text of web pages by two passes of block rules.

A page is cut into blocks at block-level tags. The first pass labels each block
from its share of linked characters, its length and its share of stop words, and
from its container. Blocks that stay undecided take the label of their nearest decided
neighbours in the second pass.
"""

import html as entities
import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|"
                 r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*+)(?:>|\Z)", re.S)
MARKED = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[^\W\d_]+")
SPACE = re.compile(r"\s+")
SENTENCE = re.compile(r"[^\W\d_].*\s.*\s.*[.!?\u2026\u3002\uff01\uff1f][\"')\]\u00bb\u201d\u2019]*$", re.S)
FOOTING = re.compile(r"\u00a9|\(c\)|copyright|all rights reserved|cookie|javascript", re.I)

INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span "
                   "strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Their content is no text of the page.
OPAQUE = frozenset("script style noscript template head title iframe object svg math select option textarea button audio video canvas".split())
RAW = frozenset("script style textarea title iframe".split())
BOILERPLATE = frozenset("nav footer aside menu dialog".split())
MAIN = frozenset("article main".split())
# Words of a class, an id or a role that mark page furniture.
FURNITURE = frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs captcha comment comments complementary consent "
                      "contentinfo cookie cookies copyright disqus dialog footer gdpr login masthead menu modal nav navbar navigation "
                      "newsletter notice notices notification pager pagination popup promo promoted promotion related respond search share "
                      "sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar topbar widget alert".split())
# Words that say where a thing is or what kind of box it has, and leave what it is to the others of the same token.
NEUTRAL = frozenset("main site page top bottom left right box list wrapper wrap container section area block slot item items bar inner outer content "
                    "primary secondary global header unit group panel region links icons buttons".split())
# Their ids are names of what they hold, as generators make them from titles.
NAMED = frozenset("h1 h2 h3 h4 h5 h6 p section article main li".split())

# Frequent function words of the languages the rules are meant for.
STOP_WORDS = frozenset((
    "a an and are as at be been but by for from had has have he her his i in is it its not of on or she that the their they this to was were which "
    "will with you aber als am an auch auf aus bei das dass dem den der des die durch ein eine einem einen einer es für hat ich im in ist mit nach "
    "nicht noch nur oder sich sie sind so und um vom von vor war wie wird wir zu zum zur au aux avec ce ces cette dans de des du elle en est et il ils "
    "je la le les leur mais ne nous on ou par pas plus pour qu que qui sa se ses son sont sur un une vous al como con del el ella en era es esta "
    "este fue ha la las le lo los más no o para pero por que se sin su sus un una y ya").split())


@dataclass(frozen=True)
class Rules:
    """Thresholds of the two passes."""
    max_link_density: float = 0.5
    stop_word_low: float = 0.15
    stop_word_high: float = 0.30
    short: int = 40
    long: int = 160


class _Page:
    """Blocks of one page as [text, linked characters, zone, heading]."""

    def __init__(self):
        self.blocks, self.pieces, self.linked, self.open = [], [], 0, []

    def zone(self) -> str:
        """What the innermost deciding container says: main, furniture, `hint` once for each hint around the block, or nothing."""
        hints = ""
        for name, zone in reversed(self.open):
            if zone == "hint":
                hints += zone
            elif zone:
                return hints if hints and zone == "main" else zone
        return hints

    def add(self, text: str, in_link: bool) -> None:
        text = entities.unescape(text) if "&" in text else text
        self.pieces.append(text)
        if in_link:
            self.linked += len(SPACE.sub("", text))

    def cut(self) -> None:
        text = SPACE.sub(" ", "".join(self.pieces)).strip()
        if text:
            self.blocks.append((text, self.linked, self.zone(), any(n[0] == "h" and n[1:].isdigit() for n, _ in self.open)))
        self.pieces, self.linked = [], 0


def _is_furniture(token: str, inside: str) -> bool:
    """Whether a whole class, id or role says so: `main-nav` does, `has-sidebar` and `related-work` do not."""
    parts = {p.lower() for p in PARTS.findall(token)}
    return bool(FURNITURE & parts) and parts <= FURNITURE | NEUTRAL or "header" in parts and parts <= NEUTRAL and inside != "main"


def _zone_of(name: str, attributes: str, inside: str) -> str:
    if name in ("body", "html"):
        return ""
    if name in BOILERPLATE or name == "header" and inside != "main":
        return "furniture"
    hinted, main = name == "form", name in MAIN
    for key, value in MARKED.findall(attributes) if attributes else ():
        key, value = key.lower(), value.strip("\"'")
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return "furniture"
        if key in ("class", "id", "role") and not (key == "id" and name in NAMED):
            hinted = hinted or any(_is_furniture(token, inside) for token in value.split())
        if key == "role" and value.lower() in ("main", "article"):
            main = True
    return "hint" if hinted else "main" if main else ""


def blocks_of(source: str) -> list[tuple]:
    """The blocks of a page in order: (text, linked characters, zone, whether a heading)."""
    page, at, opaque = _Page(), 0, None
    for m in TAG.finditer(source):
        if m.start() < at:
            continue  # inside raw content that was skipped
        closing, name, attributes = m[1], (m[2] or "").lower(), m[3]
        if opaque is None and m.start() > at:
            page.add(source[at:m.start()], any(n == "a" for n, _ in page.open))
        at = m.end()
        if not name:
            if m[0].startswith("<![CDATA[") and opaque is None:
                page.add(m[0][9:].removesuffix("]]>"), False)
            continue
        if opaque is not None:
            if name == opaque[0]:
                opaque = (name, opaque[1] + (-1 if closing else 1))
                if opaque[1] == 0:
                    opaque = None
            elif not closing and (name == "body" or name in MAIN) and opaque[0] not in RAW:
                opaque = None  # the closing tag was left out
            if opaque is not None:
                continue
            if closing:
                continue
        if name in OPAQUE and not closing:
            if attributes.rstrip().endswith("/"):
                continue
            if name in RAW:  # no markup inside: jump to the closing tag
                end = re.compile(rf"</{name}\s*>", re.I).search(source, at)
                at = end.end() if end else len(source)
            else:
                opaque = (name, 1)
            if name not in INLINE:
                page.add(" ", False)
            continue
        if name in VOID:
            if name == "br":
                page.add(" ", False)
            elif name == "hr":
                page.cut()
            continue
        if name not in INLINE:
            page.cut()
        if closing:
            for i in range(len(page.open) - 1, -1, -1):
                if page.open[i][0] == name:
                    del page.open[i:]
                    break
                if page.open[i][1] and name in ("p", "li", "b", "i", "a", "span"):
                    break  # a stray closing tag does not end its container
        elif not attributes.rstrip().endswith("/"):
            inside = page.zone()
            if name in INLINE:
                zone = ""
            else:
                zone = _zone_of(name, attributes, inside)
                if name in MAIN and inside == "furniture":  # an unclosed menu before the article, or a reader comment in it
                    zone = "furniture" if any(z == "main" for _, z in page.open) else "main"
                elif name in MAIN and inside.startswith("hint") and any(z == "main" for _, z in page.open):
                    zone = "hint"  # a reader comment
                elif inside == "furniture":
                    zone = "furniture"
                while page.open and page.open[-1][0] in INLINE and (name in ("p", "li", "div", "article", "main", "footer", "nav")):
                    page.open.pop()  # inline markup ends with its block
                if name in ("p", "li") and page.open and page.open[-1][0] == name:
                    page.open.pop()
            page.open.append((name, zone))
    if opaque is None and at < len(source):
        rest = source[at:]
        page.add(re.sub(r"<[/!a-zA-Z][^>]*\Z", "", rest), any(n == "a" for n, _ in page.open))
    page.cut()
    return page.blocks


def _stop_share(text: str) -> float:
    words = text.lower().split()
    return sum(w.strip(".,;:!?()\"'") in STOP_WORDS for w in words) / len(words)


def _by_text(text: str, linked: int, heading: bool, share: float, rules: Rules) -> str:
    """Label of a block from its text alone; `share` is that of its stop words."""
    if linked > rules.max_link_density * len(text.replace(" ", "")):
        return "bad"
    if heading:
        return "heading"
    if len(text) < rules.short:
        return "bad" if linked else "short"
    if share >= rules.stop_word_high:
        return "good" if len(text) > rules.long else "near"
    return "near" if share >= rules.stop_word_low else "bad"


def _texts(blocks: list[tuple], rules: Rules) -> list[str]:
    """Labels of the blocks from their texts.

    If no long block of the page reaches the low share of stop words, its language is
    not one of the listed ones, and length and links decide. Neighbouring undecided
    blocks of one zone are good if together they are long and have the high share.
    """
    shares = [_stop_share(b[0]) for b in blocks]
    open_ = [zone != "furniture" and linked <= rules.max_link_density * len(text.replace(" ", "")) for text, linked, zone, _ in blocks]
    known = [x for x, b, o in zip(shares, blocks, open_) if o and len(b[0]) > rules.long] or [
        x for x, b, o in zip(shares, blocks, open_) if o and len(b[0]) >= rules.short]
    if known and max(known) < rules.stop_word_low:
        shares = [1.0] * len(blocks)
    labels = ["bad" if b[2] == "furniture" else _by_text(*b[:2], b[3], x, rules) for b, x in zip(blocks, shares)]
    run = []
    for i in range(len(blocks) + 1):
        if i < len(blocks) and labels[i] == "heading":
            continue
        if run and (i == len(blocks) or labels[i] not in ("near", "short") or blocks[i][2] != blocks[run[0]][2]):
            words = [len(blocks[j][0].split()) for j in run]
            if (sum(len(blocks[j][0]) for j in run) > rules.long
                    and sum(shares[j] * n for j, n in zip(run, words)) >= rules.stop_word_high * sum(words)):
                for j in run:
                    labels[j] = "good"
            run = []
        if i < len(blocks) and labels[i] in ("near", "short"):
            run.append(i)
    return labels


def _in_main(text: str, linked: int, rules: Rules) -> str:
    """Label of a block in a container that is trusted to be the article."""
    size = len(text.replace(" ", ""))
    if linked > rules.max_link_density * size:
        return "bad" if linked == size and size < rules.short and text.count(" ") < 1 else "near"
    return "good"


def _is_sentence(text: str) -> bool:
    """Three words and more that end like a sentence and are not what stands below every page."""
    return bool(SENTENCE.match(text)) and not FOOTING.search(text)


def _first_pass(blocks: list[tuple], rules: Rules) -> list[str]:
    """Every block is labelled by its text, then by its container.

    The article and main containers are trusted if they hold at least as much text
    as the good blocks outside them. Then all of their text is good, and outside
    them only blocks that are good by themselves count. If not, they decide nothing.
    A form, or a class or an id of furniture, is a hint that counts as long as any
    text with fewer hints around it remains: good or near blocks, or a sentence however
    short. A page whose text is all that short keeps its sentences.
    """
    labels = _texts(blocks, rules)
    hints = [zone.count("hint") for _, _, zone, _ in blocks]
    said = [x in ("good", "near") or x == "short" and (zone == "main" or _is_sentence(text)) for (text, _, zone, _), x in zip(blocks, labels)]
    least = min((h for h, x in zip(hints, said) if x), default=0)
    labels = ["bad" if h > least else x for h, x in zip(hints, labels)]
    inside = [_in_main(text, linked, rules) if zone == "main" else None for text, linked, zone, _ in blocks]
    held = sum(len(b[0]) for b, x in zip(blocks, inside) if x == "good")
    if held and held >= sum(len(b[0]) for b, x, own in zip(blocks, inside, labels) if x is None and own == "good"):
        labels = [x or ("bad" if own in ("near", "short") else own) for x, own in zip(inside, labels)]
    if "good" not in labels:
        labels = ["good" if x in ("near", "short") and _is_sentence(b[0]) else x for b, x in zip(blocks, labels)]
    return labels


def _second_pass(labels: list[str]) -> list[bool]:
    """Undecided blocks follow their nearest decided neighbours; `near` ones need one good side, `short` ones two, headings one behind them."""
    before, last = [], "bad"
    for x in labels:
        before.append(last)
        last = x if x in ("good", "bad") else last
    after, last = [], "bad"
    for x in reversed(labels):
        after.append(last)
        last = x if x in ("good", "bad") else last
    after.reverse()
    keep = []
    for x, a, b in zip(labels, before, after):
        sides = (a == "good") + (b == "good")
        keep.append(x == "good" or x == "near" and sides >= 1 or x == "short" and sides == 2 or x == "heading" and b == "good")
    return keep


def main_text(source: str | None, rules: Rules = Rules()) -> str:
    """Main text of one page: its kept blocks joined by an empty line; '' for null."""
    if not source:
        return ""
    blocks = blocks_of(source)
    labels = _first_pass(blocks, rules)
    return "\n\n".join(b[0] for b, keep in zip(blocks, _second_pass(labels)) if keep)


def extract(pages: DataFrame, html: str = "html", rules: Rules = Rules()) -> DataFrame:
    """page_id, url, text and n_chars (code points of text) of every page.

    Null, empty and text-free pages give ''. A page that breaks off inside a tag or
    an element keeps what came before. Rows are independent: equal pages give equal
    rows, extra columns are not looked at, an empty table gives an empty result.
    """
    @F.pandas_udf("string")
    def texts(sources: pd.Series) -> pd.Series:
        return pd.Series([main_text(x, rules) for x in sources], dtype=object)

    out = pages.select("page_id", "url", texts(F.col(html)).alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))
