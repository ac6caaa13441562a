"""Personal information in hand-made lines, and what is none; the rest of a text stays as it is."""

from collections import Counter
from datetime import datetime as D

import pytest

from paperloom.llm import personal as P

ORDINARY = {w: 50 for w in "the a packet number wraps at sequence frame are lost source address port field bits block section syntax is user host for names stop and wait protocol selective repeat sliding window as told in class ask call if sheet written by my roll part contact retest network layer unit counter".split()}
NAMES = Counter({w: 1 for w in "zorvik velmora thiqui palrin quenbel draara servesh yolnash khavik tatam nedun grinash luvik osdak mirin".split()})


@pytest.fixture(scope="module")
def finder():
    return P.Finder(P.NameModel(NAMES, ORDINARY))


@pytest.mark.parametrize(
    ("text", "kinds"),
    [
        ("contact zorvik.pal+cn@mail.example for the retest", {"email"}),
        ("reach me at palrin_z at students dot norvale dot test after class", {"email"}),
        ("send a[at]mail[dot]example the scheme", {"email"}),
        ("send a.b @ post.invalid now", {"email"}),
        ("syntax is user@host for names", set()),
        ("call +999 555 210 6562 if the sheet is lost", {"phone"}),
        ("mob (0555) 578 5526 (home)", {"phone"}),
        ("5 5 5 2 4 3 4 4 7 0", {"phone"}),
        ("Ph: 5552047624", {"phone"}),
        ("call 555 579 1943 ext 63 now", {"phone"}),
        ("the sequence number wraps at 4294967671", set()),
        ("frame 5524 5525 5526 are lost", set()),
        ("bits 0110 1001 1100 0011 checksum", set()),
        ("source address 192.0.2.69 port 3319", set()),
        ("MAC 00:00:5E:00:53:99", set()),
        ("delay = 9954-555-54 slots", set()),
        ("my roll number is 4ZK 19 EV 112 part B", {"id_number"}),
        ("4zk23tz120", {"id_number"}),
        ("USN 9999-6413-7775", {"id_number"}),
        ("course 20EV43 is taught", set()),
        ("i live at 224 Quillback Layout Quillmere 365 130", {"address"}),
        ("Flat 14B, Brindle Lane, Tessenford - 464 433", {"address"}),
        ("P.O. Box 65, Karthbridge 760 885", {"address"}),
        ("Oldkiln House, 49 Main Rd, Karthbridge", {"address"}),
        ("address field = 49 bits, Block 4 Section 1", set()),
        ("written by Zorvik Palrin", {"name"}),
        ("ask T. Quenbel (555-354-5150)", {"name", "phone"}),
        ("Grinash, Nedun, 4zk21qx025", {"name", "id_number"}),
        ("DRAARA YOLNASH and the invigilator", {"name"}),
        ("Stop And Wait Protocol (10 frames)", set()),
        ("Velmora Polytechnic   7", set()),
        ("Network Layer, Unit 3", set()),
        ("", set()),
    ],
)
def test_line(finder, text, kinds):
    assert {k for _, _, k in finder.spans(text)} == kinds


def test_rest_is_unchanged(spark):
    t = D(2024, 1, 1)
    rows = [("A_b00_l00 ", "ask Zorvik Palrin (+999 555 210 6562) — tomorrow", t, t, 1), ("a_b00_l01", None, t, t, 1), ("a_b00_l02", "", t, t, 1), (None, "x@y.test", t, t, 1), ("a_b00_l03", "old a@b.test", t, t, 1), ("a_b00_l03", "new text", D(2024, 1, 2), t, 1)]
    lines = spark.createDataFrame(rows * 2, "line_uid string, text string, generated_at timestamp_ntz, loaded_at timestamp_ntz, kinds int")
    roster = spark.createDataFrame([(1, "Palrin, Zorvik"), (2, None)], "student int, full_name string")
    got = {r.line_uid: (r.text, r.kinds) for r in P.find_personal(lines, roster).collect()}
    assert got == {"a_b00_l00": ("ask [NAME] ([PHONE]) — tomorrow", ["name", "phone"]), "a_b00_l01": (None, []), "a_b00_l02": ("", []), "a_b00_l03": ("new text", [])}
    assert P.find_personal(lines.limit(0), roster.limit(0)).isEmpty()


def test_very_long_text(finder):
    text = "mail a.b@c.test or call 555-242-2247 now. " * 3000
    assert Counter(k for _, _, k in finder.spans(text)) == {"email": 3000, "phone": 3000}


@pytest.mark.parametrize("text", ["write a.b [at] college.edu soon", "write a.b(at)college.edu", "write x{at}y.z[dot]test today", "write x[at]y[dot]test. Then rest"])
def test_ordinary_dot_after_bracketed_at(finder, text):
    (a, b, kind), *more = finder.spans(text)
    assert kind == "email" and not more and text[a:b] == text.removeprefix("write ").removesuffix(" soon").removesuffix(" today").removesuffix(". Then rest")


@pytest.mark.parametrize("text", ["the frame waits (at) node. Then it goes on", "look at layer.two of it", "the frame (at) node"])
def test_no_email(finder, text):
    assert all(kind != "email" for _, _, kind in finder.spans(text))


@pytest.mark.parametrize(("local", "domain"), [(100, 6), (5, 130), (3000, 3000)])
def test_email_of_any_length(finder, local, domain):
    mail = "a" * local + "@" + ".".join(["b" * 30] * (domain // 30 + 1)) + ".example"
    text = f"send it to {mail}, please"
    assert finder.spans(text) == [(11, 11 + len(mail), "email")]


@pytest.mark.parametrize(
    ("text", "shown"),
    [
        ("mail a.b@c.test . my cup is full", "mail [EMAIL] . my cup is full"),
        ("see mailto:a.b@c.test today", "see mailto:[EMAIL] today"),
        ("tel:+49-30-1234567 now", "tel:[PHONE] now"),
        ("open http://a.b.test/5552437711/x and wait", "open http://a.b.test/5552437711/x and wait"),
        ("Roll No. 21-CSE-0415 sits here", "Roll No. [ID] sits here"),
        ("Aadhaar: 1234 5678 9012 given", "Aadhaar: [ID] given"),
        ("every counter of the port. Ph: 5552047624", "every counter of the port. Ph: [PHONE]"),
        ("frame sequence no. 5552047624 is lost", "frame sequence no. 5552047624 is lost"),
        ("to 12 Foxglove Road, Elmstead 365 130 by post", "to [ADDRESS] by post"),
    ],
)
def test_expanded_and_validated(finder, text, shown):
    for a, b, kind in reversed(finder.spans(text)):
        text = text[:a] + P.PLACE[kind] + text[b:]
    assert text == shown


def test_other_frames_and_names(spark):
    """Lines with other names, streets and sentences than the test tables': nine in ten of each kind come out, hardly anything else."""
    import random

    rng = random.Random(12)
    pick = rng.choice
    firsts = [a + b for a in ("Mar", "Hel", "Jon", "Ott", "Sig", "Fri", "Ann", "Bert", "Lud", "Wil") for b in ("ta", "ena", "as", "o", "rid", "eda", "ika", "hold", "wig", "ma")]
    lasts = [a + b for a in ("Kowal", "Linden", "Stein", "Berg", "Hoff", "Winter", "Nord", "Schu", "Brand", "Falk") for b in ("ski", "mann", "bach", "gren", "ström", "feld", "berg", "ner", "hauer", "sen")]
    text = "a queue holds packets until the link is idle and then the router sends them on to the next hop while timers run for every window".split()
    names = list({f"{pick(firsts)} {pick(lasts)}" for _ in range(900)})
    listed, unlisted = names[: len(names) // 2], names[len(names) // 2 :]
    frames = {
        "name": ["marked by {}", "the essay {} handed in is missing", "please give this to {} before noon", "{} sat beside the window", "signed, {}", "Dear {}, the result is out"],
        "email": ["results go to {}", "{} is the address of the office", "reply: {}", "forward everything to {} tonight"],
        "phone": ["ring {} in the evening", "phone {}", "the hostel answers on {}", "text {} when done"],
        "id_number": ["hall ticket {}", "answer book of {}", "candidate with Roll No. {} was absent", "ticket {} was swapped"],
        "address": ["parcel for {}", "they moved to {} last year", "residing at {}", "deliver it to {}, please"],
    }
    make = {
        "name": lambda: pick([lambda: pick(unlisted), lambda: pick(listed), lambda: pick(unlisted).upper(), lambda: ", ".join(pick(unlisted).split()[::-1])])(),
        "email": lambda: f"{pick(firsts).lower()}{pick(['.', '_', '-', ''])}{rng.randrange(99)}{pick(['@', ' @ ', '[at]'])}{pick(['posteo', 'uni-halle', 'mail.corp'])}.{pick(['test', 'example', 'org'])}",
        "phone": lambda: pick(["+49 555 {0} {1}", "(0555) {0} {1}", "555-{0}-{1}", "0555.{0}.{1}", "555{0}{1}"]).format(rng.randrange(200, 999), rng.randrange(1000, 9999)),
        "id_number": lambda: pick(["7QM 21 AB {0}", "7qm22ab{0}", "{0}2 4471 {0}9", "{0}24471{0}9"]).format(rng.randrange(100, 999)),
        "address": lambda: f"{pick(['', 'Flat 3C, ', 'No. '])}{rng.randrange(1, 400)} {pick(['Foxglove', 'Tanner', 'Quarry', 'Elmside'])} {pick(['Road', 'Lane', 'Street', 'Close', 'Avenue'])}, {pick(['Dunmere', 'Hexley', 'Farnborough'])}",
    }
    t = D(2024, 1, 1)
    rows, truth = [], {}
    for i in range(6000):
        words = " ".join(pick(text) for _ in range(6))
        uid, said = f"l{i}", words
        if i % 2:
            kind = pick(list(frames))
            said = f"{words}. {pick(frames[kind]).format(make[kind]())}"
            truth[uid] = kind
        elif i % 6 == 0:
            said = f"{words} {rng.randrange(10**9, 10**10)} bytes, sequence number {rng.randrange(10**9, 10**10)} from 10.0.{i % 250}.7"
        rows.append((uid, said, t, t))
    # the frames' own words are ordinary words of such lines
    rows += [(f"x{i}", pick(pick(list(frames.values()))).format("it").lower(), t, t) for i in range(1500)]
    lines = spark.createDataFrame(rows, "line_uid string, text string, generated_at timestamp_ntz, loaded_at timestamp_ntz")
    roster = spark.createDataFrame([(i, n) for i, n in enumerate(listed)], "student int, full_name string")
    got = {r.line_uid: set(r.kinds) for r in P.find_personal(lines, roster).collect()}
    for kind in frames:
        want = [u for u, k in truth.items() if k == kind]
        found = [u for u, k in got.items() if kind in k]
        right = sum(truth.get(u) == kind for u in found)
        assert right / len(want) >= 0.9 and right / len(found) >= 0.9, (kind, right, len(want), len(found))
