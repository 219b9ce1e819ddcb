"""``python -m quillsift version`` and ``help``: what the library is and what its classifier can do."""

import sys

VERSION = "0.2.0"


def main(args: list[str]) -> int:
    from quillsift.classifier import Classifier

    if args[:1] == ["version"]:
        print(f"quillsift {VERSION}")
        return 0
    commands = [(n, f.__doc__ or "") for n, f in vars(Classifier).items() if not n.startswith("_") and callable(f)]
    print("quillsift: mail classification on Spark. Commands are methods of quillsift.classifier.Classifier:")
    for name, doc in commands:
        print(f"  {name:10} {doc.strip().splitlines()[0] if doc.strip() else ''}".rstrip())
    return 0 if args[:1] in ([], ["help"]) else 2


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
