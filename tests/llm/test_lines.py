import random
import re
from collections import Counter

from quire.llm import lines


def brute(rows, ratio=0.2, least=3):
    own = []
    for i, url, html in rows:
        m = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", url or "")
        text = re.sub(lines.HIDDEN, " ", html or "", flags=re.A)
        text = re.sub(lines.TAG, "", re.sub(lines.LINE_END, "\n", text, flags=re.A))
        found = [re.sub(lines.SPACE_RUN, " ", x).strip(" ") for x in text.split("\n")]
        own.append((i, (m[1].lower() or None) if m else None, [x for x in found if x]))
    pages = Counter(h for _, h, _ in own)
    uses = Counter((h, x) for _, h, ls in own for x in set(ls))
    out = []
    for i, h, ls in own:
        kept = [x for x in ls if h is None or not (uses[h, x] >= least and uses[h, x] > ratio * pages[h])]
        out.append((i, h, len(ls), len(ls) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def test_equals_brute_force(spark):
    rng = random.Random(9)
    common = ["Home | About", "© all", "Read more", "Cookie  notice"]
    rows = []
    for i in range(300):
        host = rng.choice(["a.example"] * 3 + ["B.example:80", "c.example", f"h{i}.example"])
        parts = [rng.choice(common) for _ in range(rng.randint(0, 3))] + [f"own {i} {j}" for j in range(rng.randint(0, 3))]
        parts += [rng.choice(["seldom", "rare line", "once <b>in</b> a while"])] if rng.random() < 0.1 else []
        rng.shuffle(parts)
        body = "".join(f"<p class='x'>{x}</p>" for x in parts)
        rows.append((i, f"http://{host}/p{i}", f"<HTML><style>p{{a:b}}\n</style><script>var t='</p>';</script><!-- x\n -->{body}tail\t end<br/>"))
    rows += [(900, None, "<p>Read more</p>"), (901, "no host", "Read more"), (902, "http://a.example/", None), (903, "http://a.example/", ""),
             (None, "http://a.example/", "Read more"), (904, "http://a.example/", "<p>Read more</p>" * 20000), (5, rows[5][1], rows[5][2]),
             (5, rows[5][1], rows[5][2]), (905, "file:///x", "Read more\nHome | About")]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, Text string")
    got = [tuple(r) for r in lines.drop_boilerplate(pages).collect()]
    assert sorted(got, key=str) == brute(rows)
    assert sum(r[3] for r in got) > 100
    assert lines.drop_boilerplate(pages.filter("false")).count() == 0
