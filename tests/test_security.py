import hashlib

import pytest
from pdfmaker import N, objects

from folioframe.functions.codecs import rc4
from folioframe.sources import content, security
from folioframe.sources.pdfsyntax import Ref, Stream, load, serialise

ID = b"i" * 16


def test_aes_vectors():
    text = bytes.fromhex("00112233445566778899aabbccddeeff")
    for n, want in ((16, "69c4e0d86a7b0430d8cdb78070b4c55a"), (32, "8ea2b7ca516745bfeafc49904b496089")):
        key = bytes(range(n))
        got = security.aes_cbc_encrypt(key, text, bytes(16), padded=False)
        assert got.hex() == want and security.aes_cbc_decrypt(key, got, bytes(16), padded=False) == text
    assert security.aes_cbc_decrypt(b"k" * 16, b"v" * 16 + security.aes_cbc_encrypt(b"k" * 16, b"hello", b"v" * 16)) == b"hello"


def locked(rules, key, method):
    """A file whose strings and streams are encrypted object by object."""
    objs = objects(pages=("Secret",)) | {7: {"Title": b"T"}}

    def own(num, data):
        if method == "aes256":
            return b"v" * 16 + security.aes_cbc_encrypt(key, data, b"v" * 16)
        k = hashlib.md5(key + num.to_bytes(3, "little") + b"\0\0" + (b"sAlT" if method == "aes" else b"")).digest()[: min(16, len(key) + 5)]
        return b"v" * 16 + security.aes_cbc_encrypt(k, data, b"v" * 16) if method == "aes" else rc4(k, data)

    for n, x in objs.items():
        if isinstance(x, Stream):
            objs[n] = Stream(x.dict, own(n, x.raw))
    objs[7] = {"Title": own(7, b"T")}
    objs[8] = rules
    data = serialise(objs, {"Root": Ref(1), "ID": [ID, ID]})
    return data.replace(b"trailer\n<<", b"trailer\n<</Encrypt 8 0 R /Info 7 0 R ")


def opened(data, password=b""):
    doc = load(data, password)
    return [content.page_text(doc, p).text for _, p in doc.pages()], doc.objects[7]["Title"]


@pytest.mark.parametrize("version, revision, length, method", [(1, 2, 5, "rc4"), (2, 3, 16, "rc4"), (4, 4, 16, "aes")])
def test_old_handlers(version, revision, length, method):
    d = {"Filter": N("Standard"), "V": version, "R": revision, "P": -4, "Length": 8 * length}
    if version == 4:
        d |= {"CF": {"StdCF": {"CFM": N("AESV2")}}, "StmF": N("StdCF"), "StrF": N("StdCF")}
    owner = hashlib.md5((b"own" + security.PAD)[:32]).digest()
    if revision >= 3:
        for _ in range(50):
            owner = hashlib.md5(owner).digest()
    d["O"] = (b"usr" + security.PAD)[:32]
    for i in range(20) if revision >= 3 else (0,):
        d["O"] = rc4(bytes(b ^ i for b in owner[:length]), d["O"])
    key = security._old_key(b"usr", d, ID, length, revision)
    d["U"] = security._user_entry(key, ID, revision).ljust(32, b"\0")
    data = locked(d, key, method)
    assert opened(data, b"usr") == opened(data, b"own") == (["Secret"], b"T")
    with pytest.raises(ValueError):
        load(data, b"no")


@pytest.mark.parametrize("revision", [5, 6])
def test_new_handler(revision):
    key, zero = b"K" * 32, bytes(16)
    d = {"Filter": N("Standard"), "V": 5, "R": revision, "P": -4, "CF": {"StdCF": {"CFM": N("AESV3")}}, "StmF": N("StdCF"), "StrF": N("StdCF")}
    d["U"] = security.hash_v5(b"usr", b"12345678", b"", revision) + b"12345678abcdefgh"
    d["UE"] = security.aes_cbc_encrypt(security.hash_v5(b"usr", b"abcdefgh", b"", revision), key, zero, padded=False)
    d["O"] = security.hash_v5(b"own", b"87654321", d["U"], revision) + b"87654321hgfedcba"
    d["OE"] = security.aes_cbc_encrypt(security.hash_v5(b"own", b"hgfedcba", d["U"], revision), key, zero, padded=False)
    data = locked(d, key, "aes256")
    assert opened(data, b"usr") == opened(data, b"own") == (["Secret"], b"T")
    with pytest.raises(ValueError):
        load(data, b"no")
