"""Fixed values of queries and tests."""

from __future__ import annotations

STEM_VECTORS = {
    "бегал": "бег", "смотрела": "смотр", "гуляли": "гул", "компьютеры": "компьютер", "окнами": "окн", "красный": "красн", "большая": "больш",
    "дом": "дом", "дома": "дом", "новость": "новост", "новости": "новост", "днями": "дням", "моей": "моей", "россия": "росс",
    "увольнение": "увольнен", "льгота": "льгот",
}

RPN_VECTORS = {
    "A || B": "A B ||",
    "A || B && C": "A B C && ||",
    "(A || B) && C": "A B || C &&",
    "путин налоги": "путин налоги &&",
    "Москва !метро": "Москва метро ! &&",
    "  A    B  ": "A B &&",
    "(a) !b": "a b !",
    "(a)(b)": "a b",
    "!!a": "! a !",
    "a !!b": "a ! b ! &&",
    "!a || b": "a ! b ||",
    "(a && b": "a b && (",
    "x && (a || b": "x a b || ( &&",
    "a && b)": "a b &&",
    "a &&": "a &&",
    "a &&& b": "a && b &&",
    "": "",
}

FOLD_VECTORS = {"А": "а", "П": "п", "Ё": "ё", "A": "a", "Z": "z", "Р": "Р", "С": "С", "Я": "Я", "É": "É", "ПрИвЕт": "привет"}

#: Queries for batch search over the driver's documents, malformed ones included.
BATCH = {
    1: "the && of", 2: "the || der", 3: "!the", 4: "(the || der) && !and", 5: "the of !in", 6: "zzz && the", 7: "!zzz", 8: "(the) !of",
    9: "(the)(de)", 10: "!!the", 11: "de !!the", 12: "(the && of", 13: "in && (the || de", 14: "the &&", 15: "", 16: "la de || and !der",
}

#: The conditions that the batch queries stand for, over flags named after the terms.
BATCH_SQL = {
    1: "the AND of_", 2: "the OR der", 3: "NOT the", 4: "(the OR der) AND NOT and_", 5: "the AND of_ AND NOT in_", 6: "zzz AND the", 7: "NOT zzz", 8: "NOT of_",
    9: "de", 10: "NOT the", 11: "NOT de AND NOT the", 12: "the AND of_", 13: "FALSE", 14: "the", 15: "FALSE", 16: "(la AND de) OR (and_ AND NOT der)",
}

LETTERS = ("abcdefghijklmnopqrstuvwxyzäöüéèêçóñáíß", "абцдефгхийклмнопярстувьыжэаоуеиёчыюяъш")

#: Endings that put a word into Russian forms.
ENDINGS = ("", "а", "ями", "ого", "ейший", "ившись", "ала", "ующий", "ость", "ейте", "и", "енный")

#: Queries of three tokens, and their reverse Polish form in SQL.
FORMS = [
    ("({a} || {b}) && !{c}", "a || ' ' || b || ' || ' || c || ' ! &&'"),
    ("  {a}  {b} !{c}", "a || ' ' || b || ' && ' || c || ' ! &&'"),
    ("{a} || {b} && {c}", "a || ' ' || b || ' ' || c || ' && ||'"),
    ("!!{a}", "'! ' || a || ' !'"),
    ("({a}) !{b}", "a || ' ' || b || ' !'"),
    ("({a} && {b}", "a || ' ' || b || ' && ('"),
    ("{c} && ({a} || {b}", "c || ' ' || a || ' ' || b || ' || ( &&'"),
    ("{a} && {b})", "a || ' ' || b || ' &&'"),
    ("{a} &&& {b}", "a || ' && ' || b || ' &&'"),
]

#: (source, html, expected text or None) for the selector extractors.
ARTICLES = [
    (
        "consultant",
        "<h1 class='news-page__title'>T</h1><div class='news-page__text'><h2>A</h2><p>b <b>c</b></p><p> </p><ul><li>x</li><li></li></ul><div><p>deep</p></div></div>",
        "T\nA\nbc\nx\n",
    ),
    ("business_ru", "<h1 class='page__title'>U</h1><div class='contentSchema' itemprop='articleBody'><div><p>p1</p></div><noindex><p>ad</p></noindex><p>p2</p></div>", "U\np1\np2"),
    ("consultant", "<p>nothing</p>", None),
    ("consultant", "<div class='news-page__text'><p>only</p></div>", "\nonly"),
    ("consultant", "<div class='news-page__text'></div>", ""),
    ("elsewhere", "<p>x</p>", None),
]

LINKS = [
    ("http://a.example.com/x/y.html", "z.html", "http://a.example.com/x/z.html"),
    ("http://a.example.com/x/", "/q?p=1", "http://a.example.com/q?p=1"),
    ("http://a.example.com/x/", "https://b.example.com/", "https://b.example.com/"),
    ("http://a.example.com/x/y/", "../w", "http://a.example.com/x/w"),
]
