"""A made-up dump of five editions with what dumps get wrong, and a plain model of what is in it.

The town has a page per place; ids are the edition's base plus the place's number.
"""

import os
from collections import defaultdict

PLACES = "River Bridge Castle Forest Market Harbour Mill".split()
BASE = {"en": 1000, "nl": 2000, "pl": 3000, "pt": 4000, "sv": 5000}
# Pages of one edition only, and a second page of a title: (lang, id, title).
MORE_PAGES = [
    ("en", 1100, "Pub"),
    ("en", 1101, "Cricket_ground"),
    ("pl", 3100, "Bar_mleczny"),
    ("sv", 5003, "Castle"),
    ("sv", 5100, "Castle"),
]
# Places an edition has no page of.
LACKING = {("pt", "Mill"), ("nl", "Forest")}
# Links as numbers of places; "+n" is a page of MORE_PAGES, "!n" an id that isn't there.
PAGE_LINKS = {
    "en": "0-1 1-2 2-3 0-4 4-5 5-0 0-+100 1-!777 3-+101 1-2",
    "nl": "0-1 1-4 4-5 5-6 6-0 2-4",
    "pl": "0-2 2-4 4-6 0-+100 6-5 1-0",
    "pt": "0-3 3-5 5-4 2-0 4-2",
    "sv": "0-5 5-6 1-3 3-+100 4-1 6-0",
}
# Each edition links its places to these editions; then single lines: (file, line).
LANGUAGE_LINKS = {"en": "nl pl sv", "nl": "en pt", "pl": "en sv", "pt": "en nl pl", "sv": "en"}
ODD_LINES = [
    ("en", "1001   nl Castle \ten"),  # Bridge has two counterparts in nl
    ("en", "1002\tsv Atlantis\ten"),  # nobody has that title
    ("pl", "9999\ten River  pl"),  # no page has that id
    ("pt", "2004\tpl Market \tpt"),  # pt speaks for a page that nl has
    ("nl", "2005 en Talk:Harbour nl"),  # a namespace
    ("nl", "2005\txx Harbour nl"),  # an edition that isn't loaded
    ("sv", "no id at all here"),
    ("sv", "5004 en"),
]


def pages_of(lang):
    own = [(BASE[lang] + i, t) for i, t in enumerate(PLACES) if (lang, t) not in LACKING]
    own = [p for p in own if not any(m[:2] == (lang, p[0]) for m in MORE_PAGES)]
    return own + [m[1:] for m in MORE_PAGES if m[0] == lang]


def page_links_of(lang):
    def number(end):
        return BASE[lang] + int(end.lstrip("+!"))

    return [tuple(map(number, pair.split("-"))) for pair in PAGE_LINKS[lang].split()]


def language_lines_of(lang):
    lines = [
        f"{i}\t{other} {title} \t{lang}"
        for other in LANGUAGE_LINKS[lang].split()
        for i, title in pages_of(lang)
        if title in PLACES
    ]
    return lines + [line for file, line in ODD_LINES if file == lang]


def write_dump(folder):
    def put(lang, name, lines):
        path = os.path.join(folder, lang, name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "w") as out:
            out.write("\n".join(lines))

    for lang in BASE:
        put(lang, "page/normal_pages", [f"{i}  {t}   false false" for i, t in pages_of(lang)] + ["junk"])
        put(lang, "pagelinks", [f"{a}   {b}" for a, b in page_links_of(lang)] + ["12 -> 13"])
        put(lang, "langlinks/dumps", language_lines_of(lang))
    return folder


class Model:
    """The analyses over the sample, page by page; a page is ``(id, lang)``."""

    def __init__(self, languages, pivot="en"):
        self.pivot = pivot
        self.title = {(i, lang): t for lang in languages for i, t in pages_of(lang)}
        named = defaultdict(set)
        for page, title in self.title.items():
            named[title, page[1]].add(page)
        self.offered, self.resolved = 0, []
        for lang in languages:
            for line in language_lines_of(lang):
                fields = line.split()
                if len(fields) != 4 or not fields[0].isdigit() or ":" in fields[2]:
                    continue
                self.offered += 1
                for target in named[fields[2], fields[1]]:
                    self.resolved.append(((int(fields[0]), fields[3]), target))
        self.cross = defaultdict(lambda: defaultdict(set))
        for a, b in self.resolved:
            if a in self.title:
                for v, w in ((a, b), (a, a), (b, b), (b, a)):
                    self.cross[v][w[1]].add(w)
        self.fixed = {
            v: {lang: min(s) for lang, s in sets.items() if len(s) == 1}
            for v, sets in self.cross.items()
        }
        self.links = [((a, lang), (b, lang)) for lang in languages for a, b in page_links_of(lang)]
        self.valid = [(a, b) for a, b in self.links if a in self.cross and b in self.cross]
        self.after = defaultdict(set)
        for a, b in self.valid:
            self.after[a].add(b)

    def net(self, ego, step):
        found = reached = set(self.after[ego])
        for _ in range(step - 1):
            reached = {n for m in reached for n in self.after[m]} - found
            found = found | reached
        return found

    def delivered(self, ego, step, lang):
        """What an ego's neighbourhood is in another edition."""
        return {self.fixed[m][lang] for m in self.net(ego, step) if lang in self.fixed[m]}

    def scope(self, title):
        own = [p for p in self.cross if p[1] == self.pivot and self.title[p] == title]
        return set(self.fixed[min(own)].values()) if own else set()

    def candidates(self, title, step):
        scope, found = self.scope(title), set()
        for ego in scope:
            for lang, page in self.fixed[ego].items():
                if lang != ego[1] and page in scope and self.after[page]:
                    found |= {(page, b) for b in self.delivered(ego, step, lang)}
        return {(a, b) for a, b in found if b not in self.after[a]}

    def hears(self, egos, step):
        """Of a query's pages those with out-links to which a counterpart among them delivers."""
        return {
            page
            for ego in egos
            for lang, page in self.fixed[ego].items()
            if lang != ego[1] and self.after[page] and self.delivered(ego, step, lang)
        }

    def likeness(self, a, b, step):
        one, other = self.net(a, step), self.net(b, step)
        return len(one & other) / len(one | other)

    def ranked(self, title, step):
        found = self.candidates(title, step)
        able = {(a, b) for a, b in found if b in self.hears({b for _, b in found}, step)}
        scores = {(a, b): self.likeness(a, b, step) for a, b in able}
        placed = {a for a, _ in able}
        return scores | {(a, b): 0.0 for a, b in found if a not in placed}

    def related(self, title_a, title_b, step):
        sides = [
            {p[1]: p for p in self.scope(t) & self.hears(self.scope(t), step)} for t in (title_a, title_b)
        ]
        return {
            lang: self.likeness(sides[0][lang], sides[1][lang], step)
            for lang in sides[0].keys() & sides[1].keys()
        }
