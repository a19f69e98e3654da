"""XML texts by events against the same by trees."""

import random
import tracemalloc
import xml.etree.ElementTree as ET

from sigscan.sources import xmltext

SECTIONS = (("abstract", "Abstract", "ABSTRACT"), ("body", "Body", "BODY"))


def tree_sections(data):
    try:
        root = ET.fromstring(data)
    except (ET.ParseError, ValueError):
        return None, None
    return tuple("\n".join(t for e in root.iter() if e.tag in tags and (t := "".join(e.itertext()).strip())) or None for tags in SECTIONS)


def tree_nodes(data):
    try:
        root = ET.fromstring(data)
    except (ET.ParseError, ValueError):
        return None
    return " ".join(t for e in root.iter() if e.tag in SECTIONS[0] for d in e.iter() if d.text and (t := d.text.strip()))


def tree_own(data, tag):
    try:
        return [e.text for e in ET.fromstring(data).iter(tag) if e.text]
    except (ET.ParseError, ValueError):
        return None


def test_events_equal_trees():
    rng = random.Random(2)

    def element(depth):
        tag = rng.choice(["abstract", "ABSTRACT", "Body", "p", "b", "PublicationType", "PMID", "x:y"])
        inside = "".join(rng.choice([" ", "text", "\n", "&lt;", "&#233;", "<!-- c -->", "<?pi?>", "<![CDATA[<q>]]>", "é", "&no;" if rng.random() < 0.02 else ""]) if rng.random() < 0.6 or depth > 4 else element(depth + 1) for _ in range(rng.randint(0, 5)))
        return f"<{tag}>{inside}</{tag}>" if rng.random() < 0.98 else f"<{tag}>{inside}"

    bad = 0
    for _ in range(3000):
        data = rng.choice(["", "<!DOCTYPE a SYSTEM 'http://x/y.dtd'>"]) + f"<a xmlns:x='u'>{element(0)}{element(0)}</a>"
        for d in (data, data.encode()):
            assert xmltext.section_texts(d) == tree_sections(d), data
            assert xmltext.node_texts(d) == tree_nodes(d), data
        own = xmltext.own_texts(data, "PublicationType", "PMID")
        assert (own and own["PMID"]) == tree_own(data, "PMID") or (own is not None and own["PMID"] == []), data
        assert (None if own is None else own["PublicationType"]) == tree_own(data, "PublicationType"), data
        whole = data.encode()
        assert xmltext.section_texts(whole[k : k + 7] for k in range(0, len(whole), 7)) == tree_sections(data)
        bad += tree_sections(data) == (None, None)
    assert 100 < bad < 2900


def test_memory_is_that_of_the_sections():
    """40 MB of an article's other elements pass through in pieces."""

    def article():
        yield b"<article><abstract>short</abstract>"
        row = b"<table><tr>" + b"<td a='b'>1.5</td>" * 1000 + b"</tr></table>"
        for _ in range(40_000_000 // len(row)):
            yield row
        yield b"<body>end</body></article>"

    tracemalloc.start()
    assert xmltext.section_texts(article()) == ("short", "end")
    assert tracemalloc.get_traced_memory()[1] < 8_000_000
    tracemalloc.stop()
