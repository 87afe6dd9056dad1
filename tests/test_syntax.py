"""Tokens and objects in unusual forms, and how long reading takes."""

import time

from folioframe.plans import filecat
from folioframe.sources import builder
from folioframe.sources.pdfsyntax import Name, Parser, Ref, load


def values(data):
    p, out = Parser(data), []
    while (v := p.value()) != "" or isinstance(v, (Name, bytes)):
        out.append(v)
    return out


def test_forms_of_tokens():
    assert values(b"1 0 R 1%c\n0\r%x\nR +5 0 R -1 0 R") == [Ref(1), Ref(1), Ref(5), -1, 0, "R"]
    assert values(b"[1 0 2 0 R 1.2.3 .5 -2. 12a]") == [[1, 0, Ref(2), 0.5, -2.0]]
    assert values(rb"(a\(b\051\n)(c(d))()<4 1 4><6162>") == [b"a(b)\n", b"c(d)", b"", b"A@", b"ab"]
    assert values(b"/A#42C<</K/V/N null 5 (x)/L[true false]/D<</E 1>>>>") == ["ABC", {"K": "V", "N": None, "L": [True, False], "D": {"E": 1}}]
    assert values(b"<</A 1 /B [1 2") == [{"A": 1, "B": [1, 2]}]


def test_table_rows_of_other_forms():
    data = builder.Builder(filecat.customer_file(1, "n", 0, 0.0, "FURNITURE")).build()
    loose = data.replace(b" 00000 n\r\n", b"  00000 n \n")
    assert load(loose).rebuilt is False and load(loose).objects.keys() == load(data).objects.keys()


def test_reading_and_writing_are_quick():
    """Building and loading a file took about 15 such loops for 50 files before tokens were matched, and takes about 5."""
    specs = [filecat.customer_file(k, f"Customer#{k:09d}", k % 25, 100.0 * k, "AUTOMOBILE") for k in range(50)]
    loop = min(_seconds(lambda: sum(i * i for i in range(200_000))) for _ in range(3))
    took = min(_seconds(lambda: [load(builder.Builder(s).build()) for s in specs]) for _ in range(3))
    assert took < 10 * loop


def _seconds(f):
    start = time.process_time()
    f()
    return time.process_time() - start
