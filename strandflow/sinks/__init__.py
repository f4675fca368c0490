"""Result tables as files."""
