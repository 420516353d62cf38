import hashlib
import struct

import pytest

from tomewright.sources import files, pdf, pdfcrypt

TEXT = b"BT /F1 12 Tf 72 700 Td (sealed words) Tj ET"
ID = b"0123456789abcdef"


def test_ciphers_give_published_vectors():
    plain = bytes.fromhex("00112233445566778899aabbccddeeff")
    for bits, want in ((16, "69c4e0d86a7b0430d8cdb78070b4c55a"), (32, "8ea2b7ca516745bfeafc49904b496089")):
        key = bytes(range(bits))
        assert pdfcrypt.aes_cbc_encrypt(key, bytes(16), plain).hex() == want
        assert pdfcrypt.aes_cbc_decrypt(key, bytes(16), bytes.fromhex(want)) == plain
        long = bytes(range(256)) * 3
        assert pdfcrypt.aes_cbc_decrypt(key, plain, pdfcrypt.aes_cbc_encrypt(key, plain, long)) == long
    assert pdfcrypt.rc4(b"Key", b"Plaintext").hex() == "bbf316e8d940af0ad3"


def padded(data):
    return data + bytes([16 - len(data) % 16]) * (16 - len(data) % 16)


def classic(revision, user, owner):
    """(encryption dictionary, seal) as a writer makes them, revisions 2 to 4."""
    n, rounds = (5, 0) if revision == 2 else (16, 50)

    def stretched(seed):
        key = hashlib.md5(seed).digest()
        for _ in range(rounds):
            key = hashlib.md5(key[:n]).digest()
        return key[:n]

    held = (user + pdfcrypt.PAD)[:32]
    for i in range(1 if revision == 2 else 20):
        held = pdfcrypt.rc4(bytes(b ^ i for b in stretched((owner + pdfcrypt.PAD)[:32])), held)
    key = stretched((user + pdfcrypt.PAD)[:32] + held + struct.pack("<i", -44) + ID)
    mark = pdfcrypt.PAD if revision == 2 else hashlib.md5(pdfcrypt.PAD + ID).digest()
    for i in range(1 if revision == 2 else 20):
        mark = pdfcrypt.rc4(bytes(b ^ i for b in key), mark)

    def seal(data, number):
        salt = struct.pack("<I", number)[:3] + b"\0\0" + (b"sAlT" if revision == 4 else b"")
        own = hashlib.md5(key + salt).digest()[: min(16, n + 5)]
        return ID + pdfcrypt.aes_cbc_encrypt(own, ID, padded(data)) if revision == 4 else pdfcrypt.rc4(own, data)

    spec = f"/V {revision - 1 if revision < 4 else 4} /R {revision} /Length {8 * n} /P -44 /O <{held.hex()}> /U <{mark.ljust(32, b'.').hex()}>"
    return spec + (" /CF <</A <</CFM /AESV2>> >> /StmF /A /StrF /A" if revision == 4 else ""), seal


def modern(revision, user, owner):
    """The same for revisions 5 and 6."""
    key, salts = bytes(range(32)), (b"validate", b"keysalt.", b"ownervld", b"ownerkey")

    def digest(password, salt, more=b""):
        return hashlib.sha256(password + salt + more).digest() if revision == 5 else pdfcrypt.hardened(password, salt, more)

    u = digest(user, salts[0]) + salts[0] + salts[1]
    o = digest(owner, salts[2], u) + salts[2] + salts[3]
    ue = pdfcrypt.aes_cbc_encrypt(digest(user, salts[1]), bytes(16), key)
    oe = pdfcrypt.aes_cbc_encrypt(digest(owner, salts[3], u), bytes(16), key)
    spec = f"/V 5 /R {revision} /Length 256 /P -44 /U <{u.hex()}> /O <{o.hex()}> /UE <{ue.hex()}> /OE <{oe.hex()}>"
    return spec + " /CF <</A <</CFM /AESV3>> >> /StmF /A /StrF /A", lambda data, _: ID + pdfcrypt.aes_cbc_encrypt(key, ID, padded(data))


def sealed_pdf(spec, seal):
    content, title = seal(TEXT, 4), seal("Tïtle".encode("utf-16-be").join([b"\xfe\xff", b""]), 6)
    return (
        b"%PDF-1.7\n1 0 obj <</Type /Catalog /Pages 2 0 R>> endobj\n2 0 obj <</Type /Pages /Kids [3 0 R] /Count 1>> endobj\n"
        b"3 0 obj <</Type /Page /Parent 2 0 R /Contents 4 0 R /Resources <</Font <</F1 5 0 R>> >> >> endobj\n"
        b"4 0 obj <</Length " + str(len(content)).encode() + b">>\nstream\n" + content + b"\nendstream endobj\n"
        b"5 0 obj <</Type /Font /Subtype /Type1>> endobj\n6 0 obj <</Title <" + title.hex().encode() + b">>> endobj\n"
        b"7 0 obj <</Filter /Standard " + spec.encode() + b">> endobj\n"
        b"trailer <</Root 1 0 R /Info 6 0 R /Encrypt 7 0 R /ID [<" + ID.hex().encode() + b"> <00>]>>"
    )


@pytest.mark.parametrize("revision", [2, 3, 4, 5, 6])
@pytest.mark.parametrize("user", [b"", b"let me in"])
def test_sealed_files(revision, user):
    data = sealed_pdf(*(classic if revision < 5 else modern)(revision, user, b"owner"))
    for password in (user.decode(), "owner"):
        out = pdf.extract(data, password)
        assert out["ok"] and out["pages"] == [(0, "sealed words")] and out["encrypted"]
        assert out["meta"]["title"] == "Tïtle"
        assert pdf.info(data, password) == {
            "ok": True, "version": "1.7", "page_count": 1, "meta": out["meta"], "encrypted": True, "warning": ""
        }
    locked = pdf.extract(data, "wrong")
    assert (locked["ok"], locked["pages"], locked["meta"]["title"]) == (False, [], "")
    assert files.extract_document(data, "a.pdf")["ok"] == (user == b"")


def test_unknown_handlers_and_broken_dictionaries_are_locked():
    spec, seal = classic(3, b"", b"owner")
    good = sealed_pdf(spec, seal)
    for bad in (good.replace(b"/Standard", b"/Adobe.PubSec"), good.replace(b"/V 2", b"/V 9"), good.replace(b"/P -44", b"/P (x)")):
        out = pdf.extract(bad)
        assert not out["ok"] and out["encrypted"] and out["warning"].startswith("encrypted: ")
        assert not pdf.info(bad)["ok"]


def test_images_only_and_out_of_time():
    bare = sealed_pdf(*classic(3, b"", b"o")).replace(b" /Encrypt 7 0 R", b"").replace(b"/Contents 4 0 R", b"/Contents 8 0 R")
    out = pdf.extract(bare + b"\n8 0 obj <</Length 1>>\nstream\nq\nendstream endobj")
    assert (out["ok"], out["warning"], out["pages"]) == (True, "no text", [(0, "")])
    late = pdf.extract(bare, seconds=-1.0)
    assert not late["ok"] and late["pages"] == [] and "out of time" in late["warning"]
    assert pdf.info(b"nothing")["warning"] == "not a PDF"
