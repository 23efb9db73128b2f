"""Inputs that several test files make."""

import gzip

SF = "/root/testdata/sf0.001"


def warc_record(kind, uri, body, content_type="application/http; msgtype=response",
                http=b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n"):
    """The bytes of one record."""
    block = (http + body) if kind in ("response", "request") and http else body
    lines = ["WARC/1.0", f"WARC-Type: {kind}"]
    if uri is not None:
        lines.append(f"WARC-Target-URI: {uri}")
    lines += [f"Content-Type: {content_type}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_archive(path, records, single_member=False, tail=b"", level=6):
    """A gzip archive with one member per record, or with one in all."""
    with open(path, "wb") as f:
        members = [b"".join(records)] if single_member else records
        for data in members:
            f.write(gzip.compress(data, level))
        f.write(tail)
    return str(path)
