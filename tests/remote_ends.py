"""Ends that executors import by name: a fetcher, an endpoint and a receiver, all over folders."""

import json
import os
import uuid
from pathlib import Path


def fetch(url, options):
    Path(options["seen"], uuid.uuid4().hex).write_text(url)
    return {"html": f"<title>{url}</title>", "status_code": 404 if "gone" in url else 200, "links": [{"url": url + "/next", "text": "n"}], "crawler_type": "browser"}


class Endpoint:
    """Rows 1, 2, ... up to the number in a file."""

    def __init__(self, options):
        self.folder = Path(options["folder"])

    def latest(self):
        return int((self.folder / "latest").read_text())

    def rows(self, low, high):
        for i in range(low + 1, high + 1):
            if (self.folder / "broken").exists() and i > 12:
                raise OSError("the service is down")
            yield i, f"row {i}"


def receive(url, body, headers):
    event = json.loads(body)
    if event["event_id"] == 13 and not os.path.exists(f"{url}/tried"):
        Path(url, "tried").touch()
        raise OSError("no answer")
    Path(url, f"got-{event['event_id']}-{uuid.uuid4().hex}").write_text(json.dumps({"body": body, **headers}))
