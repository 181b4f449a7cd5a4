"""Line-by-line Python versions of the ordered rules, for comparison on random logs."""

import re


def clean(lines):
    out, last = [], None
    for number, line in enumerate(lines):
        line = line.strip()
        if not line or line == last:
            continue
        last = line
        if not line.startswith(("Downloading ", "Progress: ")):
            out.append((number, line))
    return out


def rle(lines):
    runs = []
    for line in lines:
        if runs and runs[-1][0] == line:
            runs[-1][1] += 1
        else:
            runs.append([line, 1])
    return [line if n == 1 else f"{line} (Repeated {n} times)" for line, n in runs]


def truncate(rows, max_rows, head, tail, marker):
    return rows if len(rows) <= max_rows else rows[:head] + [marker] + rows[-tail:]


def group_results(lines):
    out, passed, failed = [], 0, 0

    def flush():
        nonlocal passed, failed
        if passed:
            out.append(f"✓ {passed} tests passed")
        if failed:
            out.append(f"✗ {failed} tests failed")
        passed = failed = 0

    for line in lines:
        if re.match(r"(?i)(?:✓|PASS|ok)\s+(.*)", line):
            passed += 1
        elif re.match(r"(?i)(?:✗|FAIL)\s+(.*)", line):
            failed += 1
        else:
            flush()
            out.append(line)
    flush()
    return out


def dotnet(lines):
    errors = warnings = 0
    for line in lines:
        if ": error CS" in line:
            errors += 1
        elif ": warning CS" in line:
            warnings += 1
        m = re.search(r"(\d+) Error\(s\).*?(\d+) Warning\(s\)", line)
        if m:
            errors, warnings = int(m[1]), int(m[2])
    return errors, warnings


def gradle_events(lines):
    events = []
    for line in lines:
        task = re.match(r"> Task :(.*)", line)
        if task and any(w in task[1] for w in ("compile", "assemble", "bundle")):
            events.append("⚙ " + task[1])
        if ("error:" in line or "e: " in line) and len(events) < 10:
            events.append("✗ " + line)
    return events


def cargo_status(lines):
    status = "success"
    for line in lines:
        if "error:" in line or "error[" in line:
            status = "failure"
        if line.startswith("test result:"):
            status = "failure" if "FAILED" in line else "success"
    return status
