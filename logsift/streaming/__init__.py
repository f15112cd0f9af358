"""The stateless scoring steps, run on a file stream."""
