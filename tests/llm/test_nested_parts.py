"""Text parts are found at any depth."""

from tomoframe.llm.mailtext import text_parts


def test_text_in_deeply_nested_parts():
    mail = "Content-Type: text/plain\n\ninnermost"
    for i in range(30):
        mail = f'Content-Type: multipart/mixed; boundary="b{i}x"\n\n--b{i}x\nContent-Type: text/plain\n\nbefore {i}\n--b{i}x\n{mail}\n--b{i}x--\n'
    assert [p.strip() for p in text_parts(mail)] == [f"before {i}" for i in reversed(range(30))] + ["innermost"]
