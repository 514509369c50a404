"""AES in CBC mode, for opening locked files; its tables are made from the field's arithmetic."""

from __future__ import annotations


def _double(a: int) -> int:
    return (a << 1) ^ (0x11B if a & 0x80 else 0)


def _product(a: int, b: int) -> int:
    out = 0
    while b:
        if b & 1:
            out ^= a
        a, b = _double(a), b >> 1
    return out


def _substitutions() -> list[int]:
    out = [0x63] * 256
    power, inverse = 1, 1
    for _ in range(255):  # 3 generates the field; its inverse runs the other way
        power, inverse = _product(power, 3), _product(inverse, 0xF6)
        spread = inverse
        for k in range(1, 5):
            spread ^= (inverse << k | inverse >> (8 - k)) & 255
        out[power] = spread ^ 0x63
    return out


SBOX = _substitutions()
_INVERSE = [SBOX.index(k) for k in range(256)]
_BY = {n: [_product(k, n) for k in range(256)] for n in (2, 3, 9, 11, 13, 14)}
#: Where each byte of a column-wise state comes from when rows are shifted, one way and the other.
_SHIFT = [(k + 4 * (k % 4)) % 16 for k in range(16)]
_BACK = [(k - 4 * (k % 4)) % 16 for k in range(16)]


def round_keys(key: bytes) -> list[bytes]:
    n, rounds = len(key) // 4, len(key) // 4 + 6
    words, rcon = [list(key[k : k + 4]) for k in range(0, len(key), 4)], 1
    while len(words) < 4 * (rounds + 1):
        w = list(words[-1])
        if len(words) % n == 0:
            w = [SBOX[b] for b in w[1:] + w[:1]]
            w[0] ^= rcon
            rcon = _double(rcon)
        elif n > 6 and len(words) % n == 4:
            w = [SBOX[b] for b in w]
        words.append([a ^ b for a, b in zip(w, words[-n])])
    return [bytes(sum(words[k : k + 4], [])) for k in range(0, len(words), 4)]


def _add(a, b) -> list[int]:
    return [x ^ y for x, y in zip(a, b)]


def encrypt_block(block: bytes, keys: list[bytes]) -> bytes:
    s, two, three = _add(block, keys[0]), _BY[2], _BY[3]
    for nth, key in enumerate(keys[1:], 1):
        s = [SBOX[s[k]] for k in _SHIFT]
        if nth < len(keys) - 1:
            s = [two[s[c + r]] ^ three[s[c + (r + 1) % 4]] ^ s[c + (r + 2) % 4] ^ s[c + (r + 3) % 4] for c in (0, 4, 8, 12) for r in range(4)]
        s = _add(s, key)
    return bytes(s)


def decrypt_block(block: bytes, keys: list[bytes]) -> bytes:
    s = _add(block, keys[-1])
    by = [_BY[n] for n in (14, 11, 13, 9)]
    for nth in range(len(keys) - 2, -1, -1):
        s = _add([_INVERSE[s[k]] for k in _BACK], keys[nth])
        if nth:
            s = [by[0][s[c + r]] ^ by[1][s[c + (r + 1) % 4]] ^ by[2][s[c + (r + 2) % 4]] ^ by[3][s[c + (r + 3) % 4]] for c in (0, 4, 8, 12) for r in range(4)]
    return bytes(s)


def decrypt_cbc(key: bytes, data: bytes, iv: bytes | None = None, padded: bool = True) -> bytes:
    """The plain text; without ``iv``, the data begins with it."""
    iv, data = (data[:16], data[16:]) if iv is None else (iv, data)
    keys, out = round_keys(key), bytearray()
    for k in range(0, len(data) - len(data) % 16, 16):
        block = data[k : k + 16]
        out += bytes(_add(decrypt_block(block, keys), iv))
        iv = block
    if padded and out and 1 <= out[-1] <= 16:
        del out[-out[-1] :]
    return bytes(out)


def encrypt_cbc(key: bytes, data: bytes, iv: bytes) -> bytes:
    keys, out = round_keys(key), bytearray()
    for k in range(0, len(data), 16):
        iv = encrypt_block(bytes(_add(data[k : k + 16], iv)), keys)
        out += iv
    return bytes(out)
