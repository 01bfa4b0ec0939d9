"""Tables from and to CSV, Markdown, HTML, JSON and XLSX files."""
