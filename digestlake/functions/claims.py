"""What a witness row says, as sentences and links."""

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Codenames whose archive has moved to the old-releases host.
EOL_CODENAMES = [
    "artful", "breezy", "cosmic", "dapper", "disco", "edgy", "eoan", "feisty", "groovy", "gutsy", "hardy", "hirsute", "hoary", "impish",
    "intrepid", "jaunty", "karmic", "kinetic", "lucid", "lunar", "mantic", "maverick", "natty", "oneiric", "oracular", "precise", "quantal",
    "raring", "saucy", "utopic", "vivid", "warty", "wily", "yakkety", "zesty",
]
#: Witness prefix, attestor, name to show.
PACKAGE_PROJECTS = [
    ("fedora-core", "fedora", "Fedora Core"), ("fedora", "fedora", "Fedora"), ("epel", "epel", "EPEL"), ("rpmfusion-free", "rpmfusion", "RPM Fusion free"),
    ("rpmfusion-nonfree", "rpmfusion", "RPM Fusion nonfree"), ("vscode", "vscode", "Microsoft VS Code"), ("centos-stream", "centos", "CentOS Stream"),
    ("centos", "centos", "CentOS"), ("almalinux", "almalinux", "AlmaLinux"), ("rocky", "rocky", "Rocky Linux"), ("opensuse-leap", "opensuse", "openSUSE Leap"),
    ("opensuse", "opensuse", "openSUSE"),
]
#: Names to show for install-media witnesses.
MEDIA_NAMES = {
    "ubuntu": "Ubuntu", "kubuntu": "Kubuntu", "xubuntu": "Xubuntu", "lubuntu": "Lubuntu", "ubuntu-mate": "Ubuntu MATE", "ubuntustudio": "Ubuntu Studio",
    "ubuntu-budgie": "Ubuntu Budgie", "ubuntukylin": "Ubuntu Kylin", "ubuntucinnamon": "Ubuntu Cinnamon", "edubuntu": "Edubuntu", "ubuntu-unity": "Ubuntu Unity",
    "ubuntu-gnome": "Ubuntu GNOME", "mythbuntu": "Mythbuntu", "debian": "Debian", "fedora": "Fedora", "archlinux": "Arch Linux", "almalinux": "AlmaLinux",
    "rockylinux": "Rocky Linux", "linuxmint": "Linux Mint", "kali": "Kali Linux", "openbsd": "OpenBSD", "freebsd": "FreeBSD", "netbsd": "NetBSD", "void": "Void Linux",
    "alpine": "Alpine Linux", "opensuse": "openSUSE", "qubes": "Qubes OS", "raspberrypi": "Raspberry Pi OS", "endeavouros": "EndeavourOS", "openwrt": "OpenWrt",
    "proxmox": "Proxmox", "zorin": "Zorin OS", "centos-stream": "CentOS Stream",
}


def claim(statement: Column, url: Column) -> Column:
    return F.struct(statement.alias("statement"), url.alias("url"))


def after(text: Column, sign: str) -> Column:
    """What follows the first sign; empty without one."""
    return F.when(F.instr(text, sign) > 0, F.substring(text, F.instr(text, sign) + len(sign), F.length(text))).otherwise("")


def archive_base(witness: Column) -> Column:
    code = F.split(after(witness, "-"), "-")[0]
    return (
        F.when(witness.startswith("debian-") & witness.endswith("-security"), "https://security.debian.org/debian-security")
        .when(witness.startswith("debian-"), "https://deb.debian.org/debian")
        .when(witness.startswith("ubuntu-") & code.isin(EOL_CODENAMES), "https://old-releases.ubuntu.com/ubuntu")
        .when(witness.startswith("ubuntu-"), "https://archive.ubuntu.com/ubuntu")
        .otherwise("https://http.kali.org/kali")
    )


def witness_display(witness: Column) -> Column:
    """struct<backend, human>: by the longest known prefix that ends at a dash; the rest follows with dashes as spaces."""
    shown = lambda backend, name, rest: F.struct(backend.alias("backend"), F.when(rest == "", name).otherwise(F.concat_ws(" ", name, F.translate(rest, "-", " "))).alias("human"))
    first = F.substring_index(witness, "-", 1)
    made = shown(first, first, after(witness, "-"))
    for slug, backend, name in sorted(PACKAGE_PROJECTS, key=lambda p: len(p[0])):
        rest = F.substring(witness, len(slug) + 2, 1 << 20)
        made = F.when((witness == slug) | witness.startswith(f"{slug}-"), shown(F.lit(backend), F.lit(name), rest)).otherwise(made)
    return made


def media_name(witness: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in MEDIA_NAMES.items() for x in pair]), witness), witness)


def leaf(path: Column, sign: str = "/") -> Column:
    return F.element_at(F.split(path, re.escape(sign)), -1)


def evr(epoch: Column, version: Column, release: Column) -> Column:
    """version-release, with the epoch in front unless it is 0 or missing."""
    plain = F.concat_ws("-", version, release)
    return F.when(F.coalesce(epoch, F.lit("0")).isin("0", ""), plain).otherwise(F.concat_ws(":", epoch, plain))


@F.pandas_udf(StringType())
def percent_decoded(text: pd.Series) -> pd.Series:
    """Malformed escapes stay as they are; bytes that are no UTF-8 become replacement characters."""
    escape = re.compile(rb"%([0-9A-Fa-f]{2}|\+[0-9A-Fa-f])")
    return text.map(lambda t: None if t is None else escape.sub(lambda m: bytes([int(m[1], 16)]), t.encode()).decode(errors="replace"))


def scholarly(title: Column, year: Column, venue: Column, doi: Column, arxiv: Column, archived: Column) -> Column:
    told = F.concat(
        F.lit('scholarly file: "'), F.coalesce(title, F.lit("(untitled)")), F.lit('"'),
        F.coalesce(F.concat(F.lit(" ("), year.cast("string"), F.lit(")")), F.lit("")),
        F.coalesce(F.concat(F.lit(", "), venue), F.lit("")),
        F.coalesce(F.concat(F.lit(", doi:"), doi), F.concat(F.lit(", arXiv:"), arxiv), F.lit("")),
    )
    return claim(told, F.coalesce(archived, F.concat(F.lit("https://doi.org/"), doi), F.concat(F.lit("https://arxiv.org/abs/"), arxiv)))


def tarball(witness: Column, name: Column, version: Column, filename: Column, loc: Column) -> Column:
    told = (
        F.when(witness == "debian", F.format_string("Debian sid packages these bytes as %s (source package %s %s)", filename, name, version))
        .when(witness == "homebrew", F.format_string("Homebrew packages these bytes as %s %s (upstream source)", name, version))
        .otherwise(F.format_string("GNU Guix packages these bytes as %s", filename))
    )
    return claim(told, F.when(witness == "debian", F.concat(F.lit("https://deb.debian.org/debian/"), loc, F.lit("/"), filename)).otherwise(loc))


def census(identifier: Column, filename: Column) -> Column:
    told = F.format_string("Internet Archive item %s held these bytes as %s (April 2016 census)", F.coalesce(identifier, F.lit("?")), percent_decoded(F.coalesce(filename, F.lit("?"))))
    return claim(told, F.concat_ws("/", F.lit("https://archive.org/download"), F.coalesce(identifier, F.lit("?")), F.coalesce(filename, F.lit("?"))))


def deb(witness: Column, name: Column, version: Column, arch: Column, filename: Column) -> Column:
    project = F.substring_index(witness, "-", 1)
    told = F.format_string("%s %s ships these bytes as %s %s (%s)", F.concat(F.upper(F.substring(project, 1, 1)), F.substring(project, 2, 1 << 20)), after(witness, "-"), name, version, arch)
    return claim(told, F.concat_ws("/", archive_base(witness), filename))


def medium(witness: Column, name: Column, version: Column, filename: Column, loc: Column) -> Column:
    detail = F.concat_ws(" ", F.nullif(name, F.lit("")), F.nullif(version, F.lit("")))
    return claim(F.concat(media_name(witness), F.lit(" releases these bytes as "), filename, F.when(detail == "", "").otherwise(F.concat(F.lit(" ("), detail, F.lit(")")))), loc)


def packaged_file(witness: Column, path: Column, location: Column) -> Column:
    return claim(F.format_string("%s ships these bytes as %s in %s", witness_display(witness)["human"], path, leaf(location)), location)


def package(witness: Column, name: Column, version: Column, location: Column) -> Column:
    return claim(F.format_string("%s packages these bytes as %s (%s %s)", witness_display(witness)["human"], leaf(location), name, version), location)


def registry_url(system: Column, name: Column, version: Column) -> Column:
    link = lambda pattern, *parts: F.format_string(pattern, *parts)
    return (
        F.when(system == "CARGO", link("https://crates.io/crates/%s/%s", name, version))
        .when(system == "NPM", link("https://www.npmjs.com/package/%s/v/%s", name, version))
        .when(system == "PYPI", link("https://pypi.org/project/%s/%s/", name, version))
        .when(system == "RUBYGEMS", link("https://rubygems.org/gems/%s/versions/%s", name, version))
        .when(system == "NUGET", link("https://www.nuget.org/packages/%s/%s", name, version))
        .when((system == "MAVEN") & name.contains(":"), link("https://central.sonatype.com/artifact/%s/%s/%s", F.substring_index(name, ":", 1), after(name, ":"), version))
    )


def human_size(size: Column) -> Column:
    """B, KiB, MiB, GiB or TiB with one decimal."""
    steps = ["KiB", "MiB", "GiB", "TiB"]
    made = F.format_string("%.1f B", size.cast("double"))
    for k, unit in enumerate(steps, 1):
        made = F.when(size >= 1024**k, F.format_string(f"%.1f {unit}", size / float(1024**k))).otherwise(made)
    return made
