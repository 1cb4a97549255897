from lectern.llm import licences, urls

URLS = [
    (1, "https://www.example.com/en/5?x=/es/"),
    (2, "http://a.Example.COM/en/"),
    (3, "http://example.com/en"),
    (4, "http://badexample.com/en/x"),
    (5, "http://x.net/es/1#y"),
    (6, "http://net/fr/"),
    (7, "http://net/frx/"),
    (8, "http://com"),
    (9, None),
    (10, "no scheme"),
    (11, ""),
    (12, "http://deep.www.example.com/en/a://b/fr/"),
    (12, "http://deep.www.example.com/en/a://b/fr/"),
    (None, "ftp://x.org/é/"),
]


def brute(url):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:].split("?")[0].split("#")[0]
    best = None
    for h, p, v in urls.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, v)
    return host, path, *(best or (None, "allow"))


def test_urls_match_brute_force(spark):
    pages = spark.createDataFrame([(i, u, "mine", "mine") for i, u in URLS], "page_id long, url string, host string, verdict string")
    got = sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in urls.verdicts(pages).collect()), key=str)
    assert got == sorted(((i, *brute(u)) for i, u in URLS), key=str)
    assert urls.verdicts(pages.limit(0)).count() == 0


def test_trie_prefers_hosts_then_paths():
    trie = urls.Trie([("b.c", "/", "allow"), ("a.b.c", "", "block"), ("a.b.c", "/x/y", "allow"), ("", "/all", "block"), ("c", "/é/", "block")])
    assert trie.find("a.b.c", "")[1] == "block"
    assert trie.find("a.b.c", "/x/yz")[1] == "allow"
    assert trie.find("a.b.c", "/x")[1] == "block"
    assert trie.find("z.b.c", "/x")[1] == "allow"
    assert trie.find("other", "/allow")[1] == "block"
    assert trie.find("c", "/é/1")[1] == "block"
    assert trie.find("other", "/x") is None


def test_licences(spark):
    mit = "MIT  Licence\r\nCopyright (c) 2019 Some One\n\n" + licences.MIT.replace("sublicense", "sublicence").lower().replace(",", " ;")
    rows = [
        (1, mit),
        (2, "First line.\nRELEASED under the mit Licence!\nLast. licensed under CC-BY NC 4 0"),
        (3, None),
        (4, ""),
        (5, "...\n!!!"),
        (6, "Copyright 2020 Somebody"),
        (7, mit + " and more"),
        (2, "First line.\nRELEASED under the mit Licence!\nLast. licensed under CC-BY NC 4 0"),
        (None, "Licensed under CC BY-NC 4.0."),
    ]
    docs = spark.createDataFrame([(*r, "mine", "mine") for r in rows], "doc_id long, text string, licence string, part string")
    known = licences.known_digests(spark)
    got = sorted(((r.doc_id, r.licence, r.notices, r.n_notices, r.digest is None) for r in licences.scan(docs, known).collect()), key=str)
    assert got == sorted(
        [
            (1, "MIT", "", 0, False),
            (2, None, "MIT", 1, False),
            (2, None, "MIT", 1, False),
            (3, None, "", 0, True),
            (4, None, "", 0, True),
            (5, None, "", 0, True),
            (6, None, "", 0, True),
            (7, None, "", 0, False),
            (None, "CC-BY-NC-4.0", "CC-BY-NC-4.0", 1, False),
        ],
        key=str,
    )
    assert licences.scan(docs.limit(0), known).count() == 0
    assert licences.scan(docs, known.limit(0)).where("licence is not null").count() == 0


def test_whole_texts_and_notices(spark):
    bsd = licences._read("BSD-3-Clause").replace("University nor", "copyright holder nor").replace("THE REGENTS AND", "THE COPYRIGHT HOLDERS AND").replace("THE REGENTS OR", "THE COPYRIGHT OWNER OR")
    texts = {name: licences._read(name) for name in ("Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0", "Unlicense", "Zlib")}
    said = {"This work is licensed under the MIT License.": "MIT", "Released under CC BY-NC 4.0.": "CC-BY-NC-4.0", "Licensed under the MIT License, see LICENSE": "MIT", "Copyright The X Authors\n" + licences.MIT: "MIT"}
    said |= {"MIT License\n\nCopyright Jane Doe\n\n" + licences.MIT: "MIT", bsd: "BSD-3-Clause", bsd.replace("All rights reserved.", ""): "BSD-3-Clause", "Copyright law is old.": None}
    said |= {text: name for name, text in texts.items()}
    docs = spark.createDataFrame(list(enumerate(said)), "doc_id long, text string")
    got = {r.doc_id: r.licence for r in licences.scan(docs, licences.known_digests(spark)).collect()}
    assert [got[i] for i in range(len(said))] == list(said.values())
