"""Sources: file inventories, manifests and configuration as facts, framework routes and declarations as scans."""
