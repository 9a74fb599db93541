"""Tables, logs and files that the operators read and write."""
