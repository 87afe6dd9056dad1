"""The standard security handler: keys from passwords, and RC4 or AES decryption of strings and streams."""

from __future__ import annotations

import hashlib

from folioframe.functions.codecs import rc4

# Fixed value: the padding of passwords.
PAD = bytes.fromhex("28BF4E5E4E758A4164004E56FFFA01082E2E00B6D0683E802F0CA9FE6453697A")


def _sbox() -> tuple[bytes, bytes]:
    """The substitution box by its rule: inverses in GF(2^8), then an affine map."""
    p = q = 1
    box = [0] * 256
    while True:
        p ^= (p << 1 & 255) ^ (0x1B if p & 128 else 0)
        q ^= q << 1 & 255
        q ^= q << 2 & 255
        q ^= q << 4 & 255
        q ^= 9 if q & 128 else 0
        turned = q
        for k in (1, 2, 3, 4):
            turned ^= (q << k | q >> 8 - k) & 255
        box[p] = turned ^ 0x63
        if p == 1:
            break
    box[0] = 0x63
    inverse = [0] * 256
    for i, v in enumerate(box):
        inverse[v] = i
    return bytes(box), bytes(inverse)


SBOX, INVERSE = _sbox()


def _times(a: int, b: int) -> int:
    out = 0
    while b:
        out ^= a if b & 1 else 0
        a = (a << 1 ^ (0x11B if a & 128 else 0)) & 255 if a & 128 else a << 1
        b >>= 1
    return out


_MUL = {k: bytes(_times(i, k) for i in range(256)) for k in (2, 3, 9, 11, 13, 14)}


def _round_keys(key: bytes) -> list[bytes]:
    n = len(key) // 4
    w = [key[4 * i : 4 * i + 4] for i in range(n)]
    rcon = 1
    for i in range(n, 4 * (n + 7)):
        t = w[-1]
        if i % n == 0:
            t = bytes(SBOX[b] for b in t[1:] + t[:1])
            t = bytes([t[0] ^ rcon]) + t[1:]
            rcon = _times(rcon, 2)
        elif n > 6 and i % n == 4:
            t = bytes(SBOX[b] for b in t)
        w.append(bytes(a ^ b for a, b in zip(w[i - n], t)))
    return [b"".join(w[i : i + 4]) for i in range(0, len(w), 4)]


def _xor(a: bytes, b: bytes) -> bytes:
    return (int.from_bytes(a, "big") ^ int.from_bytes(b, "big")).to_bytes(len(a), "big")


def _block_out(keys: list[bytes], s: bytes) -> bytes:
    s = _xor(s, keys[-1])
    for k in reversed(keys[:-1]):
        s = bytes(INVERSE[s[(i - 4 * (i % 4)) % 16]] for i in range(16))
        s = _xor(s, k)
        if k is not keys[0]:
            e, b, d, n = _MUL[14], _MUL[11], _MUL[13], _MUL[9]
            mixed = bytearray()
            for c in range(0, 16, 4):
                w, x, y, z = s[c : c + 4]
                mixed += bytes((e[w] ^ b[x] ^ d[y] ^ n[z], n[w] ^ e[x] ^ b[y] ^ d[z], d[w] ^ n[x] ^ e[y] ^ b[z], b[w] ^ d[x] ^ n[y] ^ e[z]))
            s = bytes(mixed)
    return s


def _block_in(keys: list[bytes], s: bytes) -> bytes:
    s = _xor(s, keys[0])
    for k in keys[1:]:
        s = bytes(SBOX[s[(i + 4 * (i % 4)) % 16]] for i in range(16))
        if k is not keys[-1]:
            two, three = _MUL[2], _MUL[3]
            mixed = bytearray()
            for c in range(0, 16, 4):
                w, x, y, z = s[c : c + 4]
                mixed += bytes((two[w] ^ three[x] ^ y ^ z, w ^ two[x] ^ three[y] ^ z, w ^ x ^ two[y] ^ three[z], three[w] ^ x ^ y ^ two[z]))
            s = bytes(mixed)
        s = _xor(s, k)
    return s


def aes_cbc_decrypt(key: bytes, data: bytes, iv: bytes | None = None, padded: bool = True) -> bytes:
    """Without an iv the data begin with theirs."""
    if iv is None:
        iv, data = data[:16], data[16:]
    keys, out = _round_keys(key), bytearray()
    for i in range(0, len(data) - 15, 16):
        block = data[i : i + 16]
        out += _xor(_block_out(keys, block), iv)
        iv = block
    if padded and out and 1 <= out[-1] <= 16:
        del out[-out[-1] :]
    return bytes(out)


def aes_cbc_encrypt(key: bytes, data: bytes, iv: bytes, padded: bool = True) -> bytes:
    keys, out = _round_keys(key), bytearray()
    if padded:
        data += bytes([16 - len(data) % 16]) * (16 - len(data) % 16)
    for i in range(0, len(data), 16):
        iv = _block_in(keys, _xor(data[i : i + 16], iv))
        out += iv
    return bytes(out)


def hash_v5(password: bytes, salt: bytes, user: bytes, revision: int) -> bytes:
    k = hashlib.sha256(password + salt + user).digest()
    if revision < 6:
        return k
    i = 0
    while True:
        k1 = (password + k + user) * 64
        e = aes_cbc_encrypt(k[:16], k1, k[16:32], padded=False)
        k = (hashlib.sha256, hashlib.sha384, hashlib.sha512)[sum(e[:16]) % 3](e).digest()
        i += 1
        if i >= 64 and e[-1] <= i - 32:
            return k[:32]


def _old_key(password: bytes, d: dict, first_id: bytes, length: int, revision: int) -> bytes:
    h = hashlib.md5((password + PAD)[:32] + d["O"][:32] + (d["P"] & 0xFFFFFFFF).to_bytes(4, "little") + first_id)
    if revision >= 4 and d.get("EncryptMetadata") is False:
        h.update(b"\xff\xff\xff\xff")
    key = h.digest()
    if revision >= 3:
        for _ in range(50):
            key = hashlib.md5(key[:length]).digest()
    return key[:length]


def _user_entry(key: bytes, first_id: bytes, revision: int) -> bytes:
    if revision == 2:
        return rc4(key, PAD)
    out = rc4(key, hashlib.md5(PAD + first_id).digest())
    for i in range(1, 20):
        out = rc4(bytes(b ^ i for b in key), out)
    return out


class Decryptor:
    """Opens a document with a user or owner password; raises ValueError if neither fits."""

    def __init__(self, d: dict, first_id: bytes, password: bytes = b""):
        if d.get("Filter") != "Standard":
            raise ValueError("unknown security handler")
        self.version, self.revision = d.get("V", 0), d.get("R", 2)
        if self.version not in (1, 2, 4, 5):
            raise ValueError("unknown security version")
        self.kinds = {"stream": "rc4", "string": "rc4"}
        if self.version >= 4:
            for what, entry in (("stream", "StmF"), ("string", "StrF")):
                method = (d.get("CF", {}).get(d.get(entry, "Identity")) or {}).get("CFM", "None")
                self.kinds[what] = {"V2": "rc4", "AESV2": "aes", "AESV3": "aes256"}.get(str(method), "none")
        if self.version == 5:
            self.key = self._new(d, password[:127])
        else:
            length = 5 if self.version == 1 else (d.get("Length", 128 if self.version == 4 else 40)) // 8
            self.key = self._old(d, first_id, password, length)

    def _old(self, d: dict, first_id: bytes, password: bytes, length: int) -> bytes:
        n = 16 if self.revision >= 3 else 32
        key = _old_key(password, d, first_id, length, self.revision)
        if _user_entry(key, first_id, self.revision)[:n] == d["U"][:n]:
            return key
        owner = hashlib.md5((password + PAD)[:32]).digest()
        if self.revision >= 3:
            for _ in range(50):
                owner = hashlib.md5(owner).digest()
        user = d["O"][:32]
        for i in range(19, -1, -1) if self.revision >= 3 else (0,):
            user = rc4(bytes(b ^ i for b in owner[:length]), user)
        key = _old_key(user, d, first_id, length, self.revision)
        if _user_entry(key, first_id, self.revision)[:n] != d["U"][:n]:
            raise ValueError("wrong password")
        return key

    def _new(self, d: dict, password: bytes) -> bytes:
        u, o = d["U"][:48], d["O"][:48]
        for entry, wrapped, extra in ((u, "UE", b""), (o, "OE", u)):
            if hash_v5(password, entry[32:40], extra, self.revision) == entry[:32]:
                return aes_cbc_decrypt(hash_v5(password, entry[40:48], extra, self.revision), d[wrapped][:32], bytes(16), padded=False)
        raise ValueError("wrong password")

    def _apply(self, kind: str, num: int, gen: int, data: bytes) -> bytes:
        if kind == "none":
            return data
        if kind == "aes256":
            return aes_cbc_decrypt(self.key, data)
        seed = self.key + num.to_bytes(3, "little") + gen.to_bytes(2, "little") + (b"sAlT" if kind == "aes" else b"")
        own = hashlib.md5(seed).digest()[: min(16, len(self.key) + 5)]
        return aes_cbc_decrypt(own, data) if kind == "aes" else rc4(own, data)

    def string(self, num: int, gen: int, data: bytes) -> bytes:
        return self._apply(self.kinds["string"], num, gen, data)

    def stream(self, num: int, gen: int, data: bytes) -> bytes:
        return self._apply(self.kinds["stream"], num, gen, data)
