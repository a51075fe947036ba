import random
import re

from pagewright.llm import line_quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text, rules=line_quality.Rules()):
    """All measures of a text, by loops."""
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)}
    lines = text.split("\n")
    repeat = [bool(WORD.search(x)) and x in lines[:i] for i, x in enumerate(lines)]
    bad, full = [], [x for x in lines if WORD.search(x)]

    def stub(x):
        own = WORD.findall(x)
        return 0 < len(own) < 4 and not own[-1].endswith(line_quality.ENDS)

    place = -1
    for i, x in enumerate(lines):
        own = WORD.findall(x)
        if not own:
            bad.append(False)
            continue
        place += 1
        solid = "".join(own)
        letters = sum(c.isascii() and c.isalpha() or not c.isascii() for c in solid)
        ascii_letters = [c for c in x if c.isascii() and c.isalpha()]
        a = b = place
        while a > 0 and stub(full[a - 1]):
            a -= 1
        while b + 1 < len(full) and stub(full[b + 1]):
            b += 1
        count = lambda marks: sum(x.count(m) for m in marks)
        bad.append(
            repeat[i]
            or sum(c in "#*$%&|<>" for c in x) > 0.3 * len(own)
            or (len(own) >= 3 and 2 * sum(w.endswith("!!") for w in own) >= len(own))
            or (len(ascii_letters) >= 20 and sum(c.isupper() for c in ascii_letters) >= 0.7 * len(ascii_letters))
            or (len(solid) >= 8 and letters < 0.5 * len(solid))
            or 4 * count(line_quality.SEPARATORS) >= len(own) or 3 * count(line_quality.LINKS) >= len(own) or "©" in x
            or (stub(x) and b - a + 1 >= rules.menu_lines)
        )
    lost = sum(len(WORD.findall(x)) for x, y in zip(lines, bad) if y)
    base = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_dup_lines": sum(repeat), "n_repeat_words": len(covered), "base_failed": base, "n_lines": len(lines), "n_bad_lines": sum(bad),
        "lost_words": lost, "kept": not base and lost <= 0.5 * len(words), "clean_text": "\n".join(x for x, y in zip(lines, bad) if not y),
    }


def test_every_measure_against_loops(spark):
    rng = random.Random(11)
    parts = ["word", "Wörter", "HOME", "»", "·", "|", "a.", "中文。", "http://x", "www.y", "](", "©", "12", "34-56", "!!", "wow!!", "#", "\t", "\x0b", "\n", "\n", "\n\n", "\x1c", "\xa0", "the", "end;"]
    texts = ["".join(rng.choice(parts) + rng.choice([" ", " ", "", "\n"]) for _ in range(rng.randint(0, 60))) for _ in range(400)]
    texts += ["ends with ww", "w.starts another", "half ]", "(link", "x " * 3000 + "| a", "SHOUT " * 30, "one two three four five\n" * 3, None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").coalesce(1)
    for r in line_quality.clean(docs).collect():
        want = brute(texts[r.doc_id])
        assert {k: r[k] for k in want} == want, texts[r.doc_id]


def test_long_lines_and_repeated_rows(spark):
    tail = " and more words of the same line" * 40
    docs = spark.createDataFrame([(1, "© 2020 Somebody" + tail, 0), (1, "© 2020 Somebody" + tail, 0), (2, "Plain words" + tail, 0)], "doc_id int, text string, n_words int")
    got = sorted((r.doc_id, r.n_bad_lines, r.n_words) for r in line_quality.clean(docs).collect())
    assert [g[:2] for g in got] == [(1, 1), (1, 1), (2, 0)] and got[0] == got[1]
